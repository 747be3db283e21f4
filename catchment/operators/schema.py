"""Schema changes, as ordered steps over a DataFrame, and key-value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.operators.relational import replace


def migrate(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """Steps: ("add", name, type[, default]), ("drop", name), ("rename", old, new), ("alter", name, type)."""
    for step in steps:
        kind, name, *rest = step
        if kind == "add":
            value = rest[1] if len(rest) > 1 else None
            df = df.withColumn(name, F.lit(value).cast(rest[0]))
        elif kind == "drop":
            df = df.drop(name)
        elif kind == "rename":
            df = df.withColumnRenamed(name, rest[0])
        elif kind == "alter":
            df = df.withColumn(name, F.col(name).try_cast(rest[0]))
        else:
            raise ValueError(f"no such step: {kind}")
    return df


def upgrade(df: DataFrame, version: str, chain: list[tuple[str, str, list[tuple]]]) -> tuple[DataFrame, str]:
    """Applies the chain's (from, to, steps) from the version on; returns the new version."""
    for old, new, steps in chain:
        if version == old:
            df, version = migrate(df, steps), new
    return df, version


def describe(df: DataFrame) -> DataFrame:
    """place, name, type, nullable of the columns."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string, nullable boolean")


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """A key-value table with the new pairs in place of old ones."""
    return replace(store, new, ["key"])
