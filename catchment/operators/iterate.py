"""Lineage cuts for driver loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; local sessions without one get a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Types that Parquet files don't hold.
_UNWRITABLE = ("void", "interval", "variant")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, which cuts its lineage.

    The plan runs once, where a checkpoint would run its last stage twice. What Parquet can't hold is checkpointed.
    """
    shared_folder(df.sparkSession)
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or any(word in df.schema.simpleString() for word in _UNWRITABLE):
        return df.checkpoint()
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
