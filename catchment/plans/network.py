"""Routing networks. The parts stand for channels: channel k drains to (k - 1) div 2, 0 is the outlet."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import network as net
from catchment.plans.registry import query


def c(name):
    return F.col(name)


def tree(t):
    return t.part.where("p_partkey > 0").select(c("p_partkey").alias("node"), F.expr("(p_partkey - 1) div 2").alias("down"))


def sizes(t):
    return t.part.select(c("p_partkey").alias("node"), c("p_size").cast("long").alias("length"))


TREE = "WITH RECURSIVE e AS (SELECT p_partkey AS node, (p_partkey - 1) // 2 AS down FROM part WHERE p_partkey > 0), r(node, down, depth) AS (SELECT node, down, 1 FROM e UNION ALL SELECT r.node, e.down, depth + 1 FROM r JOIN e ON r.down = e.node)"

query("so_8", TREE + " SELECT node, down, CAST(depth AS INT) AS depth FROM r")(lambda t: net.closure(tree(t)))
query("so_11", TREE + " SELECT down AS root, CAST(count(*) AS BIGINT) AS descendants, CAST(max(depth) AS INT) AS depth FROM r GROUP BY 1")(
    lambda t: net.upstream(tree(t), t.part.select(c("p_partkey").alias("node"), F.lit(1).cast("long").alias("n")), ["n"]).where("depth > 0").select(c("node").alias("root"), (c("n") - 1).alias("descendants"), "depth")
)
query("gr_1", "SELECT p_partkey AS source, (p_partkey - 1) // 2 AS sink, 'tot' AS hyd_typ, 100.0 AS percent FROM part WHERE p_partkey > 0")(
    lambda t: tree(t).select(c("node").alias("source"), c("down").alias("sink"), F.lit("tot").alias("hyd_typ"), F.lit(100.0).alias("percent"))
)


def edges(t):
    """Edges with pass-through points (every seventh channel) and split flows."""
    kind = lambda k: F.when(k == 0, "X").when(k % 7 == 0, "PT").otherwise("CH")
    base = tree(t).select(c("node").alias("source"), kind(c("node")).alias("source_cat"), c("down").alias("sink"), kind(c("down")).alias("sink_cat"))
    sur = base.select("*", F.lit("sur").alias("hyd_typ"), F.when(c("source") % 11 == 0, 90.0).otherwise(100.0).alias("percent"))
    return sur


EDGES = "(SELECT node AS source, CASE WHEN node = 0 THEN 'X' WHEN node % 7 = 0 THEN 'PT' ELSE 'CH' END AS source_cat, down AS sink, CASE WHEN down = 0 THEN 'X' WHEN down % 7 = 0 THEN 'PT' ELSE 'CH' END AS sink_cat, 'sur' AS hyd_typ, CASE WHEN node % 11 = 0 THEN 90.0 ELSE 100.0 END AS percent FROM (SELECT p_partkey AS node, (p_partkey - 1) // 2 AS down FROM part WHERE p_partkey > 0))"
query("gr_2", f"SELECT source, source_cat, hyd_typ, sum(percent) AS total FROM {EDGES} GROUP BY 1, 2, 3 HAVING floor(sum(percent) + 0.5) <> 100")(lambda t: net.percent_faults(edges(t)))
query("gr_2_loops", "WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey < 8 THEN (p_partkey + 3) % 8 ELSE (p_partkey - 1) // 2 END AS down FROM part), r(node, down) AS (SELECT node, down FROM e UNION SELECT r.node, e.down FROM r JOIN e ON r.down = e.node) SELECT node FROM r WHERE node = down")(
    lambda t: net.loops(t.part.select(c("p_partkey").alias("node"), F.expr("CASE WHEN p_partkey < 8 THEN (p_partkey + 3) % 8 ELSE (p_partkey - 1) div 2 END").alias("down")))
)
for _number in (3, 4):
    query(f"gr_{_number}", f"WITH RECURSIVE e AS {EDGES}, r AS (SELECT * FROM e WHERE source_cat <> 'PT' UNION ALL SELECT r.source, r.source_cat, e.sink, e.sink_cat, e.hyd_typ, e.percent FROM r JOIN e ON r.sink_cat = 'PT' AND e.source = r.sink AND e.source_cat = 'PT') SELECT source, source_cat, sink, sink_cat, hyd_typ, percent, CAST(row_number() OVER (PARTITION BY source, source_cat ORDER BY sink_cat, sink, hyd_typ) AS INT) AS \"order\" FROM r WHERE sink_cat <> 'PT'")(
        lambda t: net.skip_points(edges(t))
    )
query("gr_5", "SELECT a.p_partkey AS channel, b.p_size AS below FROM part a JOIN part b ON b.p_partkey = (a.p_partkey - 1) // 2 WHERE a.p_partkey > 0")(
    lambda t: tree(t).join(t.part, c("down") == c("p_partkey")).select(c("node").alias("channel"), c("p_size").alias("below"))
)
query("gr_6", TREE + " SELECT node FROM r WHERE down = 5")(lambda t: net.descend(tree(t), lambda down: down == 5).select("node"))
query("gr_7", TREE + " SELECT p_partkey AS node, CAST(p_size + coalesce((SELECT sum(q.p_size) FROM r JOIN part q ON q.p_partkey = r.node WHERE r.down = part.p_partkey), 0) AS BIGINT) AS total FROM part")(
    lambda t: net.upstream_sum(tree(t), t.part.select(c("p_partkey").alias("node"), c("p_size").cast("long").alias("area")), "area")
)
# Level by level from the leaves: on this tree both children of a channel lie in the next level.
_LEVELS = "l AS (SELECT p_partkey AS node, (p_partkey - 1) // 2 AS down, CAST(floor(log2(p_partkey + 1)) AS INT) AS level FROM part), top AS (SELECT max(level) AS level FROM l)"
_STRAHLER = f"WITH RECURSIVE {_LEVELS}, s(node, down, level, strahler) AS (SELECT node, down, level, 1 FROM l WHERE level = (SELECT level FROM top) UNION ALL SELECT l.node, l.down, l.level, CASE WHEN count(x.node) = 0 THEN 1 WHEN count(x.node) = 2 AND min(x.strahler) = max(x.strahler) THEN max(x.strahler) + 1 ELSE max(x.strahler) END FROM (SELECT DISTINCT level FROM s) p JOIN l ON l.level = p.level - 1 LEFT JOIN s x ON x.down = l.node AND x.node > 0 GROUP BY 1, 2, 3) SELECT node, CAST(strahler AS INT) AS strahler FROM s"
for _number in (8, 9):
    query(f"gr_{_number}", _STRAHLER)(lambda t: net.strahler(tree(t)))
query("gr_10", TREE + " SELECT node, CAST(sum(p_size) AS BIGINT) AS length FROM r JOIN part ON p_partkey = r.down GROUP BY 1")(
    lambda t: net.descend(tree(t), lengths=sizes(t)).select("node", "length")
)
query("gr_11", TREE + ", z AS (SELECT * FROM r UNION ALL SELECT p_partkey, p_partkey, 0 FROM part) SELECT a, b, min_by(m, (s, m)) AS meet, CAST(min(s) AS INT) AS steps FROM (SELECT x.node AS a, y.node AS b, x.down AS m, x.depth + y.depth AS s FROM z x JOIN z y ON x.down = y.down AND y.node = x.node + 1 WHERE x.node < (SELECT max(p_partkey) FROM part)) GROUP BY 1, 2")(
    lambda t: net.meeting(tree(t), t.part.select(c("p_partkey").alias("a"), (c("p_partkey") + 1).alias("b")))
)
_PATH = "SELECT p_partkey AS node, list_prepend(p_partkey, coalesce((SELECT list(down ORDER BY depth) FROM r WHERE r.node = p_partkey), [])) AS path FROM part"
query("gr_12", TREE + f" SELECT node, array_to_string(path, '>') AS path FROM ({_PATH})")(lambda t: net.paths(tree(t)).select("node", F.array_join(c("path").cast("array<string>"), ">").alias("path")))


def _forks(t):
    """The ways from the outlet up to each channel and to the next, after their common part."""
    up = net.paths(tree(t)).select("node", F.reverse("path").alias("path"))
    both = up.join(up.select((c("node") - 1).alias("node"), c("path").alias("other")), "node")
    return both.select("node", *[F.array_join(x.cast("array<string>"), ">").alias(n) for x, n in zip(net.without_common_prefix(c("path"), c("other")), ("own", "other"))])


query("gr_13", TREE + f", u AS (SELECT node, list_reverse(path) AS path FROM ({_PATH})), b AS (SELECT x.node, x.path AS p, y.path AS q, len(list_filter(range(1, least(len(x.path), len(y.path)) + 1), lambda k: x.path[1:k] = y.path[1:k])) AS k FROM u x JOIN u y ON y.node = x.node + 1) SELECT node, array_to_string(p[k + 1:], '>') AS own, array_to_string(q[k + 1:], '>') AS other FROM b")(_forks)
query("gr_14", TREE + " SELECT node FROM r WHERE down = 12 UNION ALL SELECT 12")(lambda t: net.descend(tree(t), lambda down: down == 12).select("node").union(t.spark.range(12, 13)))
query("gr_15", "SELECT a.p_partkey AS channel, a.p_brand AS sub FROM part a LEFT JOIN part b ON b.p_partkey = (a.p_partkey - 1) // 2 AND a.p_partkey > 0 WHERE b.p_partkey IS NULL OR b.p_brand <> a.p_brand")(
    lambda t: t.part.alias("a").join(tree(t), c("a.p_partkey") == c("node"), "left").join(t.part.alias("b"), c("down") == c("b.p_partkey"), "left")
    .where("b.p_partkey is null or b.p_brand <> a.p_brand").select(c("a.p_partkey").alias("channel"), c("a.p_brand").alias("sub"))
)
_MOVES = "SELECT p_partkey AS node, (p_partkey - 1) // 2 AS down FROM part WHERE p_partkey > 0 AND p_size < 20"
query("gr_17", f"WITH RECURSIVE e AS ({_MOVES}), r(node, target, k) AS (SELECT node, down, 1 FROM e UNION ALL SELECT r.node, e.down, k + 1 FROM r JOIN e ON e.node = r.target) SELECT node, max_by(target, k) AS target FROM r GROUP BY 1")(
    lambda t: net.final_target(t.part.where("p_partkey > 0 and p_size < 20").select(c("p_partkey").alias("node"), F.expr("(p_partkey - 1) div 2").alias("down")))
)
# Every channel is below the threshold, or none of those between is, so one round is all; water is in every eleventh.
_CHANNELS = "k AS (SELECT p_partkey AS channel, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS down, CASE WHEN p_size < 20 THEN 1.0 ELSE 1000.0 END * p_size AS area, p_partkey % 11 = 0 AS water FROM part), e AS (SELECT a.channel, a.down FROM k a JOIN k b ON b.channel = a.down WHERE NOT a.water)"
query("gr_16", f"WITH RECURSIVE {_CHANNELS}, r(channel, target, n) AS (SELECT channel, down, 1 FROM e UNION ALL SELECT r.channel, e.down, n + 1 FROM r JOIN e ON e.channel = r.target), t AS (SELECT channel, max_by(target, n) AS target FROM r GROUP BY 1), m AS (SELECT channel, coalesce(target, channel) AS target FROM k LEFT JOIN t USING (channel)) SELECT m.channel, m.target, x.area FROM m JOIN (SELECT target, sum(area) AS area FROM m JOIN k USING (channel) GROUP BY 1) x USING (target)")(
    lambda t: net.merge_channels(
        t.part.select(c("p_partkey").alias("channel"), F.when(c("p_partkey") > 0, F.expr("(p_partkey - 1) div 2")).alias("down"), (F.when(c("p_size") < 20, 1.0).otherwise(1000.0) * c("p_size")).alias("area"), F.lit(1).alias("basin"), F.when(c("p_partkey") % 11 == 0, "water").alias("kind")), 1e12
    )
)
_FLOOD = "f AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS down, CASE WHEN p_partkey % 37 = 5 THEN 'res' || p_partkey END AS label, p_size < 30 AS flooded FROM part)"
query("gr_20", f"WITH RECURSIVE {_FLOOD}, r(node, label) AS (SELECT node, label FROM f WHERE label IS NOT NULL UNION ALL SELECT f.node, r.label FROM r JOIN f ON f.down = r.node WHERE f.label IS NULL AND f.flooded) SELECT node, label FROM r")(
    lambda t: net.spread_labels(t.part.select(c("p_partkey").alias("node"), F.when(c("p_partkey") > 0, F.expr("(p_partkey - 1) div 2")).alias("down"), F.when(c("p_partkey") % 37 == 5, F.concat(F.lit("res"), c("p_partkey").cast("string"))).alias("label"), (c("p_size") < 30).alias("flooded")))
)
query("gr_18", f"SELECT sink AS source, sink_cat AS source_cat FROM {EDGES} e WHERE sink_cat <> 'X' AND NOT EXISTS (SELECT 1 FROM {EDGES} f WHERE f.source = e.sink AND f.source_cat = e.sink_cat) GROUP BY 1, 2")(lambda t: net.dead_ends(edges(t), ["X"]))
query("wn_22", TREE + " SELECT p_brand, CAST(max(length) AS BIGINT) AS longest FROM (SELECT node, sum(p_size) AS length FROM r JOIN part ON p_partkey = r.down GROUP BY 1) x JOIN part ON p_partkey = node GROUP BY 1")(
    lambda t: net.descend(tree(t), lengths=sizes(t))
    .join(t.part, c("node") == c("p_partkey")).groupBy("p_brand").agg(F.max("length").alias("longest"))
)
