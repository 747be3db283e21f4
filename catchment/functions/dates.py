"""Calendar helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_leap(year: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29


def from_julian(year: Column, day: Column) -> Column:
    """Date of a day number in a year; numbers past its end go on into the next."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def date_key(year: Column, part: Column, grain: str) -> Column:
    """year * 1000 + day, year * 100 + month, or the year."""
    return {"day": year * 1000 + part, "month": year * 100 + part, "year": year}[grain]


def parse_any(text: Column, formats: list[str]) -> Column:
    """Time by the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def in_period(year: Column, part: Column, start: tuple[int, int], finish: tuple[int, int]) -> Column:
    """Whether (year, part) lies in a period: the start bound counts in the start year, the finish bound
    in the finish year; where both are one year, only the start bound counts."""
    (y0, p0), (y1, p1) = start, finish
    return F.when(year == y0, part >= p0).when(year == y1, part <= p1).otherwise((year > y0) & (year < y1))
