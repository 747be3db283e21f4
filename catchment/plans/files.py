"""Files of stations, observations and point sources: written from the tables, and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catchment.operators.iterate import fresh_path
from catchment.plans.registry import query
from catchment.sources import weather


def c(name):
    return F.col(name)


#: Event types stand for the five variables, in this order.
TYPES = dict(zip(["click", "error", "purchase", "signup", "view"], weather.KINDS))
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"
# A variable's station is a tenth of the users; it begins some days after the month, by its number.
_SERIES = f"""s AS (SELECT {_KIND} AS kind, 's' || user_id % 10 AS station, CAST(ts AS DATE) AS date, user_id % 10 AS n FROM events WHERE {_KIND} IS NOT NULL AND day(ts) > user_id % 10),
  f AS (SELECT kind, station, n * 1.5 AS lat, -1.0 * n AS lon, min(date) AS start, max(date) AS finish FROM s GROUP BY 1, 2, 3, 4)"""


def scanned(t):
    """Station files made of the events' daily means, scanned."""
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    n = c("user_id") % 10
    days = t.events.select(kind[c("event_type")].alias("kind"), n.alias("n"), F.to_date("ts").alias("date"), "value").where(c("kind").isNotNull() & (F.dayofmonth("date") > c("n")))
    series = days.groupBy("kind", "n", "date").agg(F.avg("value").alias("value"))
    path = fresh_path(t.spark, "stations")
    weather.write_stations(series.select("kind", F.concat(F.lit("s"), "n").alias("station"), (c("n") * 1.5).alias("lat"), (c("n") * -1.0).alias("lon"), F.lit(100.0).alias("elev"), "date", "value"), path)
    return weather.scan_stations(t.spark, path)


def dated(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


query("src_13", f"WITH {_SERIES} SELECT kind, strftime(max(start), '%Y-%m-%d') AS start, strftime(min(finish), '%Y-%m-%d') AS finish FROM f GROUP BY 1")(lambda t: dated(weather.windows(scanned(t)), "start", "finish"))
query("src_13_places", f"WITH {_SERIES} SELECT kind, station, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, strftime(start, '%Y-%m-%d') AS start, strftime(finish, '%Y-%m-%d') AS finish FROM f")(
    lambda t: dated(scanned(t), "start", "finish").select("kind", "station", "lat", "lon", "start", "finish")
)
query(
    "src_14",
    f"""WITH {_SERIES}, w AS (SELECT max(start) AS a, min(finish) AS b FROM f)
    SELECT strftime(a, '%Y-%m-%d') AS start, strftime(b, '%Y-%m-%d') AS finish, CAST(CASE WHEN dayofyear(a) = 1 THEN 0 ELSE dayofyear(a) END AS INT) AS day_start, CAST(year(a) AS INT) AS yrc_start,
      CAST(CASE WHEN month(b) = 12 AND day(b) = 31 THEN 0 ELSE dayofyear(b) END AS INT) AS day_end, CAST(year(b) AS INT) AS yrc_end FROM w""",
)(lambda t: dated(weather.simulation_window(scanned(t)), "start", "finish"))


def written(rows, **options):
    """A delimited file of few rows in their order, at a new path; the path of the file."""
    path = fresh_path(rows.sparkSession, "list")
    rows.coalesce(1).write.options(**options).csv(path)
    return f"{path}/part-*.csv"


def station_list(t):
    rows = t.supplier.orderBy("s_suppkey").select(c("s_suppkey").alias("ID"), F.concat(F.substring("s_name", 1, 3), F.lit("-"), F.substring("s_name", 4, 99)).alias("NAME"), c("s_nationkey").alias("LAT"), (c("s_nationkey") * -2).alias("LONG"), F.round("s_acctbal", 1).alias("ELEVATION"))
    return weather.read_station_list(t.spark, written(rows, header=True), "pcp")


query("src_15", "SELECT CAST(row_number() OVER (ORDER BY lower(replace(s_name, '-', '')), s_suppkey) AS BIGINT) AS place, replace(s_name, '-', '') || '.pcp' AS filename, CAST(s_suppkey AS INT) AS id, CAST(s_nationkey AS DOUBLE) AS lat, -2.0::DOUBLE * s_nationkey AS lon, round(s_acctbal, 1) AS elev FROM supplier")(
    lambda t: station_list(t).withColumn("place", c("place").cast("long"))
)


def daily(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date")).agg(F.count("*").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("flow")).orderBy("Date")


_DAILY = "d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS orders, round(max(o_totalprice), 2) AS flow FROM orders GROUP BY 1)"
query("src_26", f"WITH {_DAILY} SELECT CAST(row_number() OVER (ORDER BY date) AS INT) AS k, round(CAST(flow AS DOUBLE), 2) AS flow FROM d")(
    lambda t: weather.read_observed(t.spark, written(daily(t), header=True), "flow").select("k", F.round(c("value").cast("double"), 2).alias("flow"))
)
query("src_27", f"WITH {_DAILY} SELECT date, 'orders' AS series, CAST(orders AS DOUBLE) AS value FROM d UNION ALL SELECT date, 'flow', flow FROM d")(
    lambda t: weather.read_plot(t.spark, written(daily(t), header=True)).select("date", "series", "value")
)


def recalls(t):
    """A file for each event type, with semicolons and decimal commas, read with the number of its record."""
    out = []
    for number, kind in enumerate(TYPES, 1):
        rows = t.events.where(c("event_type") == kind).select("event_id", F.dayofyear("ts").alias("jday"), F.regexp_replace(F.format_string("%.2f", "value"), "[.]", ",").alias("flo"))
        path = fresh_path(t.spark, "recall")
        rows.write.options(sep=";", header=True).csv(path)
        out.append(weather.read_recall(t.spark, path, "event_id long, jday int, flo double", number))
    return reduce(lambda a, b: a.unionByName(b), out)


query("src_28", "SELECT event_id, CAST(dayofyear(ts) AS INT) AS jday, round(value, 2) AS flo, CASE event_type " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(TYPES, 1)) + f" END AS recall FROM events WHERE event_type IN ({', '.join(repr(k) for k in TYPES)})")(
    lambda t: recalls(t).withColumn("flo", F.round("flo", 2))
)
