"""Aggregates beyond the built-in ones.

Null keys are a group of their own; null values don't count, as in the built-in ones; empty tables give
no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of products over the sum of weights; where that is zero, the raw sum of values."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.when(F.sum(weight) != 0, F.sum(weight))), F.sum(value))


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name of ``shares``, the percentile at that share, interpolated between neighbours.

    Rows come down to counts of distinct values, which are dealt by ranges; places are counted inside
    a range and begin after those before it, so no group's values meet in a task. Null values don't
    count, groups without others have no row; null keys are a group.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    rows = cut(rows.repartitionByRange(*by, "_x").withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_size")
    parts = parts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), before.alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_all"))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = F.sum("_n").over(Window.partitionBy("_part", *by).orderBy("_x")) - F.col("_n")
    placed = rows.withColumn("_first", inside).join(parts, same).withColumn("_first", F.col("_first") + F.col("_before"))
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_all") - 1)
        # A value takes the places from _first on; each of the two neighbours of the place is in one value.
        holds = lambda k: (F.col("_first") <= k) & (k < F.col("_first") + F.col("_n"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col("_x"))), F.max(F.when(holds(F.ceil(at)), F.col("_x")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*by).agg(*out)


def gaps(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least and mean gap between neighbours in order of value, and the range, for each key.

    The mean of the gaps is the range over their number; one value has gaps of 0, none has null.
    """
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(value))
    rows = df.where(F.col(value).isNotNull()).select(*by, value, (F.col(value) - before).alias("gap"))
    n, span = F.count("*"), F.max(value) - F.min(value)
    return rows.groupBy(*by).agg(
        F.coalesce(F.min("gap"), F.lit(0.0)).alias("least_gap"),
        F.when(n == 1, 0.0).otherwise(F.try_divide(span, n - 1)).alias("mean_gap"),
        span.alias("span"),
    )


def time_gaps(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """The same for times, in seconds; the least gap of a single time is null."""
    rows = df.where(F.col(time).isNotNull()).select(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    before = F.lag("us").over(Window.partitionBy(*by).orderBy("us"))
    n, span = F.count("*"), (F.max("us") - F.min("us")) / 1e6
    return rows.withColumn("gap", (F.col("us") - before) / 1e6).groupBy(*by).agg(
        F.min("gap").alias("least_gap"), F.when(n == 1, 0.0).otherwise(F.try_divide(span, n - 1)).alias("mean_gap"), span.alias("duration")
    )


def mode_first(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each key; ties go to the one seen first in ``order``."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias("mode"))


def dominant(df: DataFrame, by: list[str], key: list[str], area: str) -> DataFrame:
    """Key with the largest total area over zero; ties go to the smallest key."""
    totals = df.groupBy(*by, *key).agg(F.sum(area).alias("area")).where("area > 0")
    w = Window.partitionBy(*by).orderBy(F.desc("area"), *key)
    return totals.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def histogram_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, greatest, count, mean and population deviation from frequencies of values."""
    f = df.groupBy(*by, value).agg(F.count("*").alias("f"))
    n, mean = F.sum("f"), F.sum(F.col("f") * F.col(value)) / F.sum("f")
    square = F.sum(F.col("f") * F.col(value) * F.col(value)) / F.sum("f")
    return f.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("deviation"))


def table_hash(df: DataFrame) -> DataFrame:
    """Order-free hash of all rows: their count and the sum of 60-bit pieces of each row's MD5."""
    text = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in sorted(df.columns)]))
    piece = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(piece).cast("string").alias("hash"))
