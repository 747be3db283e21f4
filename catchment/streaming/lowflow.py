"""Least running totals of each hydrological year, from a table or from a stream of daily rows with state.

Both give unit, hydro, least, rows: the least total over ``days`` successive rows inside the year that starts in ``hydro``
(null with fewer rows), and the rows of the year, which tell whether it is complete. Of a day that is given twice the
greatest value counts; rows without a unit or a day are left out, and a null value is a row that its totals lack.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EPOCH, DAY_MS = datetime.date(1970, 1, 1), 86_400_000


def yearly_low_flows(rows: DataFrame, unit: str, day: str, value: str, days: int = 7, month: int = 1) -> DataFrame:
    """The least totals of a table, by windows."""
    known = rows.select(F.col(unit).cast("string").alias("unit"), F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("value")).where("unit is not null and day is not null")
    one = known.groupBy("unit", "day").agg(F.max("value").alias("value"))
    year = one.withColumn("hydro", F.year("day") - F.when(F.month("day") < month, 1).otherwise(0))
    line = Window.partitionBy("unit", "hydro").orderBy("day")
    span = line.rowsBetween(1 - days, 0)
    totals = year.select("unit", "hydro", F.when(F.count("*").over(span) == days, F.sum("value").over(span)).alias("total"))
    return totals.groupBy("unit", "hydro").agg(F.min("total").alias("least"), F.count("*").cast("int").alias("rows"))


class _Unit:
    """One unit's state: days that may still get rows, and the year that they are taken into, in order."""

    def __init__(self, held: dict | None, days: int, month: int):
        held = held or {"open": {}, "tail": [], "year": None, "least": None, "rows": 0, "seen": None}
        self.open = {int(k): v for k, v in held["open"].items()}
        self.tail, self.year, self.least, self.rows, self.seen = (held[k] for k in ("tail", "year", "least", "rows", "seen"))
        self.days, self.month = days, month

    def held(self) -> dict:
        return {"open": self.open, "tail": self.tail, "year": self.year, "least": self.least, "rows": self.rows, "seen": self.seen}

    def add(self, day: int, value: float | None) -> None:
        if self.seen is None or day > self.seen:
            old = self.open.get(day)
            self.open[day] = value if old is None else old if value is None else max(old, value)

    def year_of(self, day: int) -> int:
        date = EPOCH + datetime.timedelta(day)
        return date.year - (date.month < self.month)

    def end(self) -> int:
        """The first day after the year that is open."""
        return (datetime.date(self.year + 1, self.month, 1) - EPOCH).days

    def close(self) -> tuple[int, float | None, int]:
        out = (self.year, self.least, self.rows)
        self.tail, self.year, self.least, self.rows = [], None, None, 0
        return out

    def settle(self, before: int) -> list[tuple[int, float | None, int]]:
        """Takes in the days before ``before``, which get no more rows; the years that have ended."""
        out = []
        for day in sorted(d for d in self.open if d < before):
            value, self.seen = self.open.pop(day), day
            if self.year is not None and self.year_of(day) != self.year:
                out.append(self.close())
            self.year = self.year_of(day)
            self.rows += 1
            self.tail = [*self.tail, value][-self.days :]
            present = [v for v in self.tail if v is not None]
            if len(self.tail) == self.days and present:
                total = sum(present)
                self.least = total if self.least is None else min(self.least, total)
        if self.year is not None and self.end() <= before:
            out.append(self.close())
        return out


def low_flow_stream(stream: DataFrame, unit: str, day: str, value: str, days: int = 7, month: int = 1, late: str = "10 days") -> DataFrame:
    """The least totals of a stream; a year comes out once the watermark has passed its end.

    Rows may come in any order within ``late``; what comes later is dropped. A unit's state holds the days within ``late`` and the
    last ``days`` values, however long the stream. Years that no later row has ended stay in the state.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = _Unit(json.loads(state.get[0]) if state.exists else None, days, month)
        for frame in frames:
            for d, v in zip(frame["_day"], frame["value"]):
                own.add(int(d), None if pd.isna(v) else float(v))
        mark = state.getCurrentWatermarkMs()
        done = own.settle(-(-mark // DAY_MS))
        state.update((json.dumps(own.held()),))
        if own.open or own.year is not None:
            state.setTimeoutTimestamp(max(mark + 1, (min(own.open) * DAY_MS if own.open else own.end() * DAY_MS) + 1))
        if done:
            yield pd.DataFrame([(key[0], *row) for row in done], columns=["unit", "hydro", "least", "rows"])

    known = stream.select(F.col(unit).cast("string").alias("unit"), F.unix_date(F.col(day).cast("date")).alias("_day"), F.col(value).cast("double").alias("value")).where("unit is not null and _day is not null")
    timed = known.withColumn("_time", F.timestamp_seconds(F.col("_day") * 86400)).withWatermark("_time", late)
    return timed.groupBy("unit").applyInPandasWithState(work, "unit string, hydro int, least double, rows int", "held string", "append", GroupStateTimeout.EventTimeTimeout)
