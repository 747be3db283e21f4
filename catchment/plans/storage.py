"""Scans, exports as lines, schema changes, and windowed streams run as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import schema
from catchment.plans.registry import query
from catchment.sources import text, writers
from catchment.streaming import daily, lowflow


def c(name):
    return F.col(name)


query("src_23", "SELECT o_orderkey, o_totalprice FROM orders")(lambda t: t.orders.select("o_orderkey", "o_totalprice"))
query("src_25", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")(lambda t: t.orders.where("o_totalprice > 100000 and o_orderstatus = 'O'").select("o_orderkey"))
query("src_18", "SELECT v.vec_id FROM embeddings v, (SELECT min(embedding[1]) AS a, max(embedding[1]) AS b FROM embeddings WHERE label = 1) x WHERE v.embedding[1] BETWEEN a - 0.01 AND b - 0.3")(
    lambda t: t.embeddings.crossJoin(F.broadcast(t.embeddings.where("label = 1").agg(F.min(c("embedding")[0]).alias("a"), F.max(c("embedding")[0]).alias("b")))).where((c("embedding")[0].cast("double") >= c("a") - 0.01) & (c("embedding")[0].cast("double") <= c("b") - 0.3)).select("vec_id")
)
query("src_20", "SELECT s_suppkey, CAST(k AS INT) AS layer, round(s_acctbal * k, 6) AS depth FROM supplier, range(1, 4) r(k) WHERE k <= s_nationkey % 3 + 1")(
    lambda t: text.layers(t.supplier.select("s_suppkey", (c("s_nationkey") % 3 + 1).alias("n"), *[F.round(c("s_acctbal") * k, 6).alias(f"z{k}") for k in (1, 2, 3)]), ["s_suppkey"], "n", {"depth": ["z1", "z2", "z3"]})
)
query("src_31", "SELECT min(value) AS low, max(value) AS high, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS deviation FROM events")(
    lambda t: t.events.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_pop("value"), 8).alias("deviation"))
)
query("snk_2", "SELECT CAST(place AS INT) AS place, value FROM (SELECT 0 AS place, lpad('s_suppkey', 10, ' ') || '  ' || rpad('s_name', 20, ' ') || '  ' || lpad('s_acctbal', 14, ' ') AS value UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey), lpad(CAST(s_suppkey AS VARCHAR), 10, ' ') || '  ' || rpad(s_name, 20, ' ') || '  ' || lpad(printf('%.5f', s_acctbal), 14, ' ') FROM supplier)")(
    lambda t: writers.fixed_lines(t.supplier, [("s_suppkey", "int", 10), ("s_name", "string", 20), ("s_acctbal", "double", 14)], ["s_suppkey"])
)
query("snk_9", "SELECT n_nationkey, rtrim(n_nationkey || '  ' || n_name || coalesce((SELECT string_agg('  ' || s_suppkey || '  ' || s_nationkey * 2, '' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '')) AS value FROM nation")(
    lambda t: writers.parent_lines(t.nation.select("n_nationkey", "n_name"), t.supplier.select("s_nationkey", "s_suppkey", c("s_suppkey").alias("k"), (c("s_nationkey") * 2).alias("x")), "n_nationkey", "s_nationkey", "s_suppkey")
)
query("snk_13", "SELECT 'part' AS name, CAST(count(*) AS BIGINT) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")(lambda t: writers.counts({"part": t.part, "supplier": t.supplier}))
def monthly(t):
    months = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("flow"), (F.max("o_totalprice") / 1e9).alias("share"))
    return months.unpivot(["year", "month"], ["orders", "flow", "share"], "label", "value")


# The years that all tables have whole.
query(
    "snk_30",
    """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS p, count(*)::DOUBLE AS orders, avg(o_totalprice) AS flow, max(o_totalprice) / 1e9 AS share FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000 GROUP BY 1)
    SELECT CAST(p - 1995 * 12 + 1 AS INT) AS place, (p // 12) || '/' || (p % 12 + 1) AS "Date", format('{:.3g}', orders) AS orders, format('{:.3g}', flow) AS flow, format('{:.3g}', share) AS share FROM m""",
)(lambda t: writers.plot_table(monthly(t), ["orders", "flow", "share"], (1995, 1), (2000, 12)))
query("so_24", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 'x' AS extra FROM nation")(
    lambda t: schema.migrate(t.nation.select("n_nationkey", "n_name", "n_regionkey"), [("rename", "n_name", "name"), ("alter", "n_regionkey", "string"), ("add", "extra", "string", "x")])
)
query("stream_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")(
    lambda t: daily.window_means(t.events, "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))
)
query("stream_sessions", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s")(
    lambda t: daily.sessions(t.events, "ts", "user_id").select("user_id", "n")
)

_FLOWS = "d AS (SELECT o_orderpriority AS unit, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS value FROM orders GROUP BY 1, 2), y AS (SELECT *, year(day) - CASE WHEN month(day) < 4 THEN 1 ELSE 0 END AS hydro FROM d)"
_TOTALS = "t AS (SELECT unit, hydro, CASE WHEN count(*) OVER w = 7 THEN sum(value) OVER w END AS total FROM y WINDOW w AS (PARTITION BY unit, hydro ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"
query("stream_low_flow", f"WITH {_FLOWS}, {_TOTALS} SELECT unit, CAST(hydro AS INT) AS hydro, round(min(total), 4) AS least, CAST(count(*) AS INT) AS rows FROM t GROUP BY 1, 2")(
    lambda t: lowflow.yearly_low_flows(t.orders, "o_orderpriority", "o_orderdate", "o_totalprice", 7, 4).withColumn("least", F.round("least", 4))
)
