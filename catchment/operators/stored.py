"""Tables of the session's catalog: made, filled, changed, renamed, described and dropped.

Tables are Parquet files in the folder that driver and executors share. A change of rows writes the
new rows beside the old ones and then points the table at them, so readers never see half of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.operators.iterate import cut, fresh_path


def fresh_name(base: str) -> str:
    """A table name that nothing uses."""
    return f"{base}_{uuid.uuid4().hex}"


def create(df: DataFrame, name: str) -> str:
    """CREATE TABLE AS; returns the name. A table of that name is an error."""
    df.write.option("path", fresh_path(df.sparkSession, name)).saveAsTable(name)
    return name


def insert(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """INSERT ... SELECT, columns by name; missing ones are null. Returns the rows inserted."""
    table = spark.table(name)
    new = cut(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]))
    new.write.insertInto(name)
    return new


def insert_values(spark: SparkSession, name: str, values: list[str | None]) -> DataFrame:
    """Inserts one row of texts, cast to the columns' types."""
    fields = spark.table(name).schema
    row = spark.range(1).select(*[F.lit(v).try_cast(f.dataType).alias(f.name) for v, f in zip(values, fields, strict=True)])
    return insert(spark, name, row)


def rewrite(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Replaces all rows of a table; ``rows`` may be read from it."""
    path = fresh_path(spark, name)
    rows.select(spark.table(name).columns).write.parquet(path)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)


def update(spark: SparkSession, name: str, test: Column, **values) -> None:
    """UPDATE ... SET ... WHERE; a null test changes nothing."""
    table = spark.table(name)
    kinds = {f.name: f.dataType for f in table.schema}
    rewrite(spark, name, table.withColumns({c: F.when(test, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(kinds[c]) for c, v in values.items()}))


def update_ids(spark: SparkSession, name: str, key: str, ids: DataFrame, **values) -> None:
    """UPDATE for the keys in ``ids`` (one column), however many there are."""
    table = spark.table(name)
    marked = table.join(ids.select(F.col(ids.columns[0]).alias(key), F.lit(True).alias("_hit")).distinct(), key, "left")
    rewrite(spark, name, marked.withColumns({c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))


def delete(spark: SparkSession, name: str, test: Column | None = None) -> None:
    """DELETE ... WHERE; without a test all rows go. Rows for which the test is null stay."""
    rewrite(spark, name, spark.table(name).where(F.lit(False) if test is None else ~F.coalesce(test, F.lit(False))))


def rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def drop(spark: SparkSession, name: str) -> None:
    """DROP TABLE IF EXISTS; the files of a table in the shared folder stay until that is cleared."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def columns(spark: SparkSession, name: str) -> DataFrame:
    """place, name, type of a table's columns, from the catalog."""
    rows = [(k, c.name, c.dataType) for k, c in enumerate(spark.catalog.listColumns(name))]
    return spark.createDataFrame(rows, "place int, name string, type string")


def tables(spark: SparkSession, ending: str = "") -> DataFrame:
    """name of the catalog's tables that end so."""
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables() if t.name.endswith(ending)], "name string")


def new_names(files: DataFrame, kind: str) -> DataFrame:
    """file, name: names for new tables: the stem if it holds ``kind``, else ``kind_lookup``; the second of a name gets 0, the third 1.

    ``files`` has file and stem; names are given in the order of file.
    """
    from pyspark.sql import Window

    base = F.when(F.contains(F.lower("stem"), F.lit(kind)), F.col("stem")).otherwise(F.lit(f"{kind}_lookup"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("file"))
    return files.withColumn("base", base).select("file", F.concat("base", F.when(k > 1, (k - 2).cast("string")).otherwise("")).alias("name"))


def in_order(keys: DataFrame) -> DataFrame:
    """name, place: tables so that each comes after those its keys point to; of equal depth by name.

    ``keys``: name, parent (null for none). A table comes after all that it reaches, and reaches more
    than any of them. Tables in a ring of keys come last.
    """
    from pyspark.sql import Window

    from catchment.operators.network import closure

    reach = closure(keys.select(F.col("name").alias("node"), F.col("parent").alias("down")))
    reached = reach.groupBy(F.col("node").alias("name")).agg(F.count("*").alias("n"), F.max(F.col("node") == F.col("down")).alias("ring"))
    names = keys.select("name").unionByName(keys.where("parent is not null").select(F.col("parent").alias("name"))).distinct()
    w = Window.partitionBy().orderBy(F.coalesce("ring", F.lit(False)), F.coalesce("n", F.lit(0)), "name")
    return names.join(reached, "name", "left").select("name", F.row_number().over(w).alias("place"))
