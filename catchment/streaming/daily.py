"""Streaming over daily values: rolling windows with late data, and a session count per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_means(stream: DataFrame, time: str, key: str, value: str, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, key, n, mean for tumbling (or sliding) windows; rows later than ``late`` are dropped by a stream."""
    w = F.window(F.col(time).cast("timestamp"), length, slide) if slide else F.window(F.col(time).cast("timestamp"), length)
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """start, finish, key, n for runs of rows with no gap as long as ``gap``."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    s = F.session_window(F.col(time), gap)
    return rows.groupBy(s.alias("s"), key).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("finish"), key, "n")
