"""Resampling, period summaries, flow quantiles and low-flow statistics."""

from __future__ import annotations

import calendar
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.functions.dates import is_leap


def resample(df: DataFrame, time: str, value: str, grain: str) -> DataFrame:
    """date, mean: means by day, month or year, labelled by the last day."""
    start = F.date_trunc(grain, F.col(time)).cast("date")
    label = {"day": start, "month": F.last_day(start), "year": F.make_date(F.year(start), F.lit(12), F.lit(31))}[grain]
    return df.groupBy(label.alias("date")).agg(F.avg(value).alias("mean"))


def period_lengths(start: date, finish: date) -> tuple[int, float, float]:
    """Days, months and years of a period, both ends included; a year counts by the share of its days."""
    years = 0.0
    for y in range(start.year, finish.year + 1):
        first, last = max(start, date(y, 1, 1)), min(finish, date(y, 12, 31))
        years += ((last - first).days + 1) / (366 if calendar.isleap(y) else 365)
    return (finish - start).days + 1, 12 * years, years


def summaries(value: str, start: date, finish: date) -> dict[str, Column]:
    """Totals, means over the period, maxima (at least 0) and minima; nulls count as 0."""
    days, months, years = period_lengths(start, finish)
    v = F.coalesce(F.col(value), F.lit(0.0))
    return {
        "total": F.sum(v), "annual": F.sum(v) / years, "monthly": F.sum(v) / months, "daily": F.sum(v) / days,
        "maximum": F.greatest(F.lit(0.0), F.max(v)), "minimum": F.coalesce(F.min(v), F.lit(float("inf"))),
    }


def flow_quantile(df: DataFrame, time: str, value: str, exceeded: float) -> DataFrame:
    """month, q: the value exceeded ``exceeded`` per cent of the time in each calendar month."""
    return df.groupBy(F.month(time).alias("month")).agg(F.percentile(value, (100 - exceeded) / 100).alias("q"))


def ranked_quantile(df: DataFrame, by: list[str], value: str, exceeded: float) -> DataFrame:
    """First value in descending order whose rank share 100 * i / (n + 1) is over ``exceeded``."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc(value))
    rows = df.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(order).alias("i"), F.count("*").over(w).alias("n"))
    return rows.where(100 * F.col("i") / (F.col("n") + 1) > exceeded).groupBy(*by).agg(F.min_by(value, "i").alias("q"))


def hydrological_years(df: DataFrame, day: str, month: int) -> DataFrame:
    """Rows from the first start of a hydrological year on, with ``hydro`` (the year it starts in)."""
    year = F.year(day) - F.when(F.month(day) < month, 1).otherwise(0)
    rows = df.withColumn("hydro", year)
    first = df.agg(F.min(day).alias("first")).select(F.when((F.month("first") == month) & (F.dayofmonth("first") == 1), F.year("first")).otherwise(F.year("first") + F.when(F.month("first") >= month, 1).otherwise(0)).alias("first_hydro"))
    return rows.crossJoin(F.broadcast(first)).where("hydro >= first_hydro").drop("first_hydro")


def _complete(rows: DataFrame, month: int) -> DataFrame:
    """Without the last hydrological year if it lacks rows."""
    february = F.col("hydro") + (1 if month > 2 else 0)
    size = rows.groupBy("hydro").agg(F.count("*").alias("n"))
    last = size.agg(F.max_by("n", "hydro").alias("n"), F.max("hydro").alias("last"))
    full = last.select("last", (F.col("n") >= F.when(is_leap(F.col("last") + (1 if month > 2 else 0)), 366).otherwise(365)).alias("full"))
    return rows.crossJoin(F.broadcast(full)).where("full or hydro < last").drop("full", "last")


def low_flow(df: DataFrame, day: str, value: str, days: int, month: int, percent: float | None) -> DataFrame:
    """dQp: the percentile (or mean, without one) of the yearly least ``days``-row totals, over days.

    ``df`` has a row for each day. Windows run inside a hydrological year, over rows.
    """
    rows = _complete(hydrological_years(df, day, month), month)
    w = Window.partitionBy("hydro").orderBy(day)
    totals = rows.select("hydro", F.sum(value).over(w.rowsBetween(1 - days, 0)).alias("total"), F.row_number().over(w).alias("k")).where(F.col("k") >= days)
    least = totals.groupBy("hydro").agg(F.min("total").alias("least"))
    pick = F.avg("least") if percent is None else F.percentile("least", percent / 100)
    return least.agg((pick / days).alias("flow"))


def base_flow(df: DataFrame, day: str, value: str, month: int, longest: int = 100) -> DataFrame:
    """Qb: mean over years of the least i-day mean at its greatest relative rise from i - 1 to i."""
    rows = _complete(hydrological_years(df, day, month), month)
    w = Window.partitionBy("hydro").orderBy(day)
    sums = rows.select("hydro", day, F.row_number().over(w).alias("k"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    # Totals of i rows are differences of running sums; each row has those of the rows before it, the nearest first.
    before = sums.withColumn("before", F.reverse(F.collect_list("s").over(w.rowsBetween(-longest, -1))))
    before = before.withColumn("before", F.when(F.col("k") <= longest, F.concat("before", F.array(F.lit(0.0)))).otherwise(F.col("before")))
    spans = before.select("hydro", F.posexplode(F.transform("before", lambda s0, i: (F.col("s") - s0) / (i + 1))).alias("i", "a"))
    means = spans.groupBy("hydro", "i").agg(F.min("a").alias("a"))
    prior = F.lag("a").over(Window.partitionBy("hydro").orderBy("i"))
    rises = means.withColumn("rise", F.when(prior > 0, (F.col("a") - prior) / prior))
    best = rises.groupBy("hydro").agg(F.max_by("a", F.when(F.col("rise") > 0, F.struct(F.col("rise"), -F.col("i")))).alias("a"))
    return best.agg(F.avg(F.coalesce("a", F.lit(0.0))).alias("flow"))


def monthly_factors(df: DataFrame, day: str, value: str) -> DataFrame:
    """month, factor: root of the month's mean over the least monthly mean; 1 where that is 0."""
    means = df.groupBy(F.month(day).alias("month")).agg(F.avg(value).alias("mean"))
    least = means.agg(F.min("mean").alias("least"))
    return means.crossJoin(F.broadcast(least)).select("month", F.when(F.col("least") == 0, 1.0).otherwise(F.sqrt(F.col("mean") / F.col("least"))).alias("factor"))
