"""Readers of model text files: simulation outputs, station weather, delimited tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key columns that every output table begins with.
PREFIX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("jday", "mon", "day", "yr", "unit", "gis_id")] + [T.StructField("name", T.StringType())])

#: First data line (from 1) of the tables that differ from the usual; fixed values of the format.
START_LINE = {"crop_yld_aa": 6, "flow_duration_curve": 3, "basin_pest_aa": 3, "hru_pest_aa": 3, "channel_pest_aa": 3}
USUAL_START = 4


def start_line(table: str) -> int:
    if table.startswith("crop_yld"):
        return START_LINE["crop_yld_aa"]
    if "_pest_" in table or table.endswith("_pest"):
        return START_LINE["hru_pest_aa"]
    return START_LINE.get(table, USUAL_START)


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line (from 1), value of text files. A file is split in one task; files are spread over tasks."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("l"))
    return whole.select("path", F.posexplode("l").alias("line", "value")).withColumn("line", F.col("line") + 1)


def _typed(token: Column, kind: T.DataType) -> Column:
    """A token as a value: a star anywhere or nothing at all is null, as is what can't be read."""
    clean = F.when(~F.contains(token, F.lit("*")) & (token != ""), token)
    return clean if isinstance(kind, T.StringType) else clean.try_cast(kind.simpleString())


def read_output(spark: SparkSession, path: str | list[str], schema: T.StructType, start: int | None = None) -> DataFrame:
    """Rows of an output file, tokens bound to ``schema`` by position; short lines end in nulls.

    Where gis_id is 0, it becomes the digits of name (null if there are none).
    """
    return parse_output(lines(spark, path), schema, start)


def parse_output(rows: DataFrame, schema: T.StructType, start: int | None = None) -> DataFrame:
    """The same for lines (line, value) from anywhere."""
    start = start or USUAL_START
    rows = rows.where((F.col("line") >= start) & (F.trim("value") != ""))
    tokens = F.split(F.trim("value"), r"\s+")
    rows = rows.select(*[_typed(F.get(tokens, F.lit(k)), f.dataType).alias(f.name) for k, f in enumerate(schema.fields)])
    if {"gis_id", "name"} <= set(schema.names):
        digits = F.regexp_replace("name", "[^0-9]", "").try_cast("int")
        rows = rows.withColumn("gis_id", F.when(F.col("gis_id") == 0, digits).otherwise(F.col("gis_id")))
    return rows


def column_units(spark: SparkSession, path: str, start: int = USUAL_START) -> DataFrame:
    """place, name, units from an output file's two header lines; a header ``null`` takes no unit."""
    return parse_units(lines(spark, path), start)


def parse_units(rows: DataFrame, start: int = USUAL_START) -> DataFrame:
    """The same for lines (line, value) from anywhere."""
    head = rows.where(F.col("line") == start - 2).select(F.split(F.trim("value"), r"\s+").alias("names"))
    unit = rows.where(F.col("line") == start - 1).select(F.split(F.trim("value"), r"\s+").alias("units"))
    named = head.select(F.posexplode("names").alias("place", "name"))
    taken = F.sum(F.when(F.col("name") == "null", 0).otherwise(1)).over(Window.partitionBy().orderBy("place"))
    units = unit.select(F.posexplode("units").alias("k", "units"))
    named = named.withColumn("k", F.when(F.col("name") == "null", None).otherwise((taken - 1).cast("int")))
    return named.join(F.broadcast(units), "k", "left").select("place", "name", "units")


def manifest(spark: SparkSession, path: str) -> list[str]:
    """Output files that a manifest names: the last token of each line, tables only. A model has some hundreds."""
    return [r["file"] for r in parse_manifest(spark.read.text(path)).collect()]


def parse_manifest(rows: DataFrame) -> DataFrame:
    """file: the same for lines (value) from anywhere."""
    last = F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    return rows.select(last.alias("file")).where(F.col("file").endswith(".txt") | F.col("file").isin("crop_yld_aa.out", "flow_duration_curve.out"))


def read_table(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", lower_names: bool = True, decimal_comma: bool = False) -> DataFrame:
    """A delimited file by position; ``null`` is null; a decimal comma becomes a point."""
    raw = spark.read.csv(path, sep=delimiter, header=True, nullValue="null", schema=T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]), enforceSchema=True, mode="FAILFAST")
    out = []
    for f in schema.fields:
        x = F.trim(F.col(f.name))
        if isinstance(f.dataType, T.StringType):
            out.append((F.lower(x) if lower_names and f.name == "name" else x).alias(f.name))
        else:
            x = F.regexp_replace(x, "^([^,]*),", "$1.") if decimal_comma and delimiter != "," else x
            out.append(x.try_cast(f.dataType.simpleString()).alias(f.name))
    return raw.select(*out)


def read_station(spark: SparkSession, paths: str | list[str], values: int = 1) -> DataFrame:
    """path, date, value... of station files: line 3 names the place, lines from 4 on are year, day of year, values."""
    rows = lines(spark, paths).where((F.col("line") >= 4) & (F.trim("value") != ""))
    tokens = F.split(F.trim("value"), r"\s+")
    day = F.date_add(F.make_date(F.get(tokens, F.lit(0)).try_cast("int"), F.lit(1), F.lit(1)), F.get(tokens, F.lit(1)).try_cast("int") - 1)
    return rows.select("path", day.alias("date"), *[_typed(F.get(tokens, F.lit(2 + k)), T.DoubleType()).alias("value" if values == 1 else f"value_{k + 1}") for k in range(values)])


def station_places(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, years, step, lat, lon, elev of station files."""
    tokens = F.split(F.trim("value"), r"\s+")
    return lines(spark, paths).where("line = 3").select("path", *[F.get(tokens, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("years", "step", "lat", "lon", "elev"))])


def common_window(series: DataFrame, by: str) -> DataFrame:
    """start, finish: the latest first and the earliest last date over all series."""
    spans = series.groupBy(by).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return spans.agg(F.max("a").alias("start"), F.min("b").alias("finish"))


def read_dense(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, date, value of dense files: a first line YYYYMMDD, then a value for each day."""
    return parse_dense(lines(spark, paths))


def parse_dense(rows: DataFrame) -> DataFrame:
    """The same for lines (path, line, value) from anywhere."""
    first = rows.where("line = 1").select("path", F.to_date(F.trim("value"), "yyyyMMdd").alias("start"))
    return rows.where((F.col("line") > 1) & (F.trim("value") != "")).join(first, "path").select("path", F.date_add("start", (F.col("line") - 2).cast("int")).alias("date"), F.trim("value").try_cast("double").alias("value"))


def layers(wide: DataFrame, keys: list[str], count: str, names: dict[str, list[str]]) -> DataFrame:
    """Wide records (columns name1, name2, ...) as a row for each of their first ``count`` layers."""
    depth = max(len(v) for v in names.values())
    each = [F.struct(*[F.col(v[k]).alias(n) for n, v in names.items() if k < len(v)]) for k in range(depth)]
    rows = wide.select(*keys, F.col(count).alias("_n"), F.posexplode(F.array(*each)).alias("layer", "x"))
    return rows.where("layer < _n").select(*keys, (F.col("layer") + 1).alias("layer"), "x.*")
