"""All queries: name to Spark callable, and name to DuckDB SQL over the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, each read when it is first asked for: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers ``f(tables) -> DataFrame`` under ``name``, with the DuckDB SQL of the same result."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catchment.plans.fit import monthly_fit

    return monthly_fit(spark, sf_dir)


for _module in ("fit", "relational", "scalars", "series", "network", "landunits", "terrain", "reports", "sampling", "storage", "exchange", "files", "calibration"):
    importlib.import_module(f"catchment.plans.{_module}")
