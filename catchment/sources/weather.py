"""Weather stations as files: written from tables by tasks, scanned for places and spans; station lists, observed columns, point sources.

A station's file lies in ``kind=<variable>/station=<name>``: two title lines, a line of years, step, latitude, longitude and elevation,
then year, day of year and value a line. Files are spread over tasks; one file is read by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.functions.dates import is_leap
from catchment.sources.delimited import dialect, read_delimited
from catchment.sources.text import lines, read_station, station_places
from catchment.sources.writers import numbered

#: The variables of a simulation: humidity, precipitation, solar radiation, temperature, wind.
KINDS = ["hmd", "pcp", "slr", "tmp", "wnd"]
LIST_HEADER = ["ID", "NAME", "LAT", "LONG", "ELEVATION"]


def write_stations(series: DataFrame, path: str) -> None:
    """Writes ``series`` (kind, station, lat, lon, elev, date, value) as a file for each kind and station.

    A null value is written as -99, the format's mark; rows without a kind, a station or a date are left out. A station's place is that of its first date.
    """
    known = series.where("kind is not null and station is not null and date is not null")
    spans = known.groupBy("kind", "station").agg(
        (F.year(F.max("date")) - F.year(F.min("date")) + 1).alias("years"), *[F.min_by(c, "date").alias(c) for c in ("lat", "lon", "elev")]
    )
    head = F.array(
        F.concat(F.col("kind"), F.lit(": station "), F.col("station").cast("string")),
        F.lit("nbyr tstep lat lon elev"),
        F.format_string("%d 0 %.3f %.3f %.3f", F.col("years"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("lat", "lon", "elev")]),
    )
    heads = spans.select("kind", "station", F.posexplode(head).alias("place", "line"))
    # Lines of data come after the three of the head, in the order of their days.
    data = known.select("kind", "station", (F.unix_date(F.to_date("date")) + 1_000_000).alias("place"), F.format_string("%d %d %.5f", F.year("date"), F.dayofyear("date"), F.coalesce(F.col("value").cast("double"), F.lit(-99.0))).alias("line"))
    dealt = heads.unionByName(data).repartition("kind", "station").sortWithinPartitions("kind", "station", "place")
    dealt.select("kind", "station", "line").write.partitionBy("kind", "station").text(path)


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with kind and station, from their path: once escaped as a folder's name, and once more as a URI."""
    plain = lambda x: F.url_decode(F.regexp_replace(x, "[+]", "%2B"))
    part = lambda name: plain(plain(F.regexp_extract("path", f"/{name}=([^/]*)/", 1)))
    return rows.withColumns({"kind": part("kind"), "station": part("station")})


def scan_stations(spark: SparkSession, path: str) -> DataFrame:
    """kind, station, lat, lon, elev, start, finish of every station file: its place, first and last date."""
    files = f"{path}/kind=*/station=*/*"
    places = station_places(spark, files).select("path", "lat", "lon", "elev")
    spans = read_station(spark, files).groupBy("path").agg(F.min("date").alias("start"), F.max("date").alias("finish"))
    return _named(places.join(spans, "path", "left")).drop("path")


def windows(scanned: DataFrame) -> DataFrame:
    """kind, start, finish: for each variable the latest first and the earliest last date of its stations."""
    return scanned.groupBy("kind").agg(F.max("start").alias("start"), F.min("finish").alias("finish"))


def simulation_window(scanned: DataFrame) -> DataFrame:
    """start, finish, day_start, yrc_start, day_end, yrc_end over all variables; a first of January and a 31st of December are coded 0."""
    both = scanned.agg(F.max("start").alias("start"), F.min("finish").alias("finish"))
    first, last = F.dayofyear("start"), F.dayofyear("finish")
    whole = F.when(is_leap(F.year("finish")), 366).otherwise(365)
    return both.select("start", "finish", F.when(first > 1, first).otherwise(F.when(first.isNotNull(), 0)).alias("day_start"), F.year("start").alias("yrc_start"), F.when(last < whole, last).otherwise(F.when(last.isNotNull(), 0)).alias("day_end"), F.year("finish").alias("yrc_end"))


def read_station_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """place, filename, id, lat, lon, elev of an older list of stations: names lose their dashes, and files are numbered by name, whatever its case.

    A list with another header is an error.
    """
    found = [x.strip() for x in dialect(spark, path)[2]]
    if found != LIST_HEADER:
        raise ValueError(f"a station list begins with {','.join(LIST_HEADER)}, not {','.join(found)}")
    rows = read_delimited(spark, path, "id int, name string, lat double, lon double, elev double", delimiter=",", header=True)
    named = rows.select(F.concat(F.regexp_replace("name", "-", ""), F.lit(f".{kind}")).alias("filename"), "id", "lat", "lon", "elev")
    return numbered(named, [F.lower("filename"), F.col("filename"), F.col("id")], "place")


def read_observed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """k (from 1), value: the texts of the column that the first line calls ``name``, up to the first line that is too short for it.

    A file without that column is an error. Dates aren't looked at: rows are told apart by their number.
    """
    names = [x.strip() for x in (spark.read.text(path).first() or [""])[0].split(",")]
    if name not in names:
        raise ValueError(f"no column {name} in {', '.join(names)}")
    place = names.index(name)
    tokens = F.split("value", ",")
    rows = lines(spark, path).where("line > 1").select((F.col("line") - 1).alias("k"), F.trim(F.get(tokens, F.lit(place))).alias("value"), (F.size(tokens) > place).alias("full"))
    # A column at the first place is in every line, so a blank line ends it by being blank.
    rows = rows.withColumn("full", F.col("full") & ~((F.lit(place) == 0) & (F.col("value") == "")))
    end = rows.where(~F.col("full")).agg(F.min("k").alias("end"))
    return rows.crossJoin(F.broadcast(end)).where("end is null or k < end").select(F.col("k").cast("int").alias("k"), "value")


def read_plot(spark: SparkSession, path: str) -> DataFrame:
    """k, date, series, text, value: every cell of a plot's file as it stands, and as a number where it is one."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    first, *series = rows.columns
    cells = rows.select(F.trim(F.col(f"`{first}`")).alias("date"), F.explode(F.array(*[F.struct(F.lit(c.strip()).alias("series"), F.trim(F.col(f"`{c}`")).alias("text")) for c in series])).alias("c"))
    return cells.select("date", "c.series", "c.text", F.col("c.text").try_cast("double").alias("value"))


def read_recall(spark: SparkSession, path: str, schema: str, recall: int) -> DataFrame:
    """The rows of a point source's file with ``recall``, the number of its record; with another delimiter than a comma, decimal commas are points."""
    return read_delimited(spark, path, schema).withColumn("recall", F.lit(recall))
