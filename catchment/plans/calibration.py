"""Calibration and sensitivity runs, natural breaks, cell networks, and insert reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from catchment.operators import calibration, landunits, network, relational, sampling
from catchment.plans.landunits import GRID, UNITS, grid, rounded, units
from catchment.plans.registry import query
from catchment.plans.sampling import normal_inverse_sql


def c(name):
    return F.col(name)


PARAMS = [("cn2", 35.0, 95.0), ("esco", 0.0, 1.0), ("awc", -0.25, 0.25)]

#: A parameter of each distribution: name, kind and its settings.
DISTRIBUTIONS = [("cn2", "uniform", [35.0, 95.0]), ("esco", "triangular", [0.1, 0.3, 0.9]), ("awc", "trapezoidal", [0.1, 0.3, 0.6, 0.9]), ("k", "normal", [0.5, 0.2]), ("slope", "lognormal", [-1.0, 0.5])]
_DRAWS = {
    "uniform": "35 + 60 * u", "triangular": "CASE WHEN u < 0.25 THEN 0.1 + sqrt(u * 0.8 * 0.2) ELSE 0.9 - sqrt((1 - u) * 0.8 * 0.6) END",
    "trapezoidal": "CASE WHEN u < 0.2 / 1.1 THEN 0.1 + sqrt(u * 1.1 * 0.2) WHEN u <= 0.8 / 1.1 THEN (u * 1.1 + 0.4) / 2 ELSE 0.9 - sqrt((1 - u) * 1.1 * 0.3) END", "normal": f"0.5 + 0.2 * ({normal_inverse_sql()})", "lognormal": f"exp(-1 + 0.5 * ({normal_inverse_sql()}))",
}
query("sa_1", "WITH x AS (SELECT o_orderkey, (o_totalprice + 1) / (max(o_totalprice) OVER () + 2) AS u FROM orders) " + " UNION ALL ".join(f"SELECT o_orderkey, '{name}' AS param, round({_DRAWS[kind]}, 7) AS value FROM x" for name, kind, _ in DISTRIBUTIONS))(
    lambda t: (lambda x: x.select("o_orderkey", F.inline(F.array(*[F.struct(F.lit(name).alias("param"), F.round(sampling.quantile(c("u"), kind, settings), 7).alias("value")) for name, kind, settings in DISTRIBUTIONS]))))(
        t.orders.crossJoin(F.broadcast(t.orders.agg(F.max("o_totalprice").alias("top")))).select("o_orderkey", ((c("o_totalprice") + 1) / (c("top") + 2)).alias("u"))
    )
)
_NEXT = "((p_partkey + 1) * 16807) % 2147483647"
query("sa_6", f"SELECT p_partkey, {_NEXT} AS seed, CAST(greatest(3, least(40, floor((1 - r) * 2.5 + r * 40.5 + 0.5))) AS BIGINT) AS value FROM (SELECT p_partkey, {_NEXT} / 2147483647 AS r FROM part)")(
    lambda t: t.part.select("p_partkey", sampling.next_seed(c("p_partkey") + 1).alias("seed"), sampling.uniform_integer(3, 40, c("p_partkey") + 1).alias("value"))
)
_SOBOL = "list_reduce([(xor(i, i >> 1) >> k & 1) * v[k + 1] FOR k IN range(30)], lambda a, b: xor(a, b))"


def _sobol_sql(dimensions):
    return ", ".join(f"({k}, {sampling.sobol_directions(k)})" for k in range(dimensions))


query("sa_5", f"SELECT i, CAST(d AS INT) AS dimension, {_SOBOL} / 1073741824 AS u FROM (SELECT p_partkey AS i FROM part), (VALUES {_sobol_sql(40)}) z(d, v)")(
    lambda t: sampling.sobol_points(t.part.select(c("p_partkey").alias("i")), "i", 40)
)
query("sa_27", "SELECT i - 1 AS run, param, low + (high - low) * " + _SOBOL + f" / 1073741824 AS value FROM range(1, 257) r(i), (VALUES {_sobol_sql(3)}) z(d, v) JOIN (VALUES (0, 'cn2', 35.0, 95.0), (1, 'esco', 0.0, 1.0), (2, 'awc', -0.25, 0.25)) p(d, param, low, high) USING (d)")(lambda t: sampling.sobol_sample(t.spark, 256, PARAMS))
query("sa_19", "SELECT round(regr_r2(y, x), 6) AS r2, round(corr(x, y), 6) AS src FROM (SELECT ln(o_totalprice) AS y, o_custkey AS x FROM orders)")(
    lambda t: (lambda b, r2: t.spark.createDataFrame([(round(r2, 6), round(b["x"], 6))], "r2 double, src double"))(*sampling.regression_coefficients(t.orders.select(c("o_custkey").cast("double").alias("x"), F.ln("o_totalprice").alias("y")), ["x"], "y"))
)
query("sa_21", "SELECT o_orderkey, k AS param, CASE WHEN k = 'a' THEN b ELSE a END AS value FROM (SELECT o_orderkey, o_totalprice AS a, o_custkey * 1.0 AS b FROM orders), (VALUES ('a'), ('b')) v(k)")(
    lambda t: t.orders.select("o_orderkey", c("o_totalprice").alias("a"), (c("o_custkey") * 1.0).alias("b")).crossJoin(F.broadcast(t.spark.createDataFrame([("a",), ("b",)], "param string"))).select("o_orderkey", "param", F.when(c("param") == "a", c("b")).otherwise(c("a")).alias("value"))
)
query("sa_23", "SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 4) AS mean, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM orders")(
    lambda t: (lambda w: t.orders.select("o_custkey", "o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("mean"), F.count("*").over(w).alias("n")))(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
)
query("sa_24")(lambda t: calibration.morris(t.spark, PARAMS, 40, seed=2))


def _walks(t):
    """A trajectory of four points in three dimensions for each nation."""
    k = c("n_nationkey")
    start = [(k * m) % 4 / 3.0 for m in (7, 5, 3)]
    points = [F.array(*[start[d] + F.when(F.pmod(k + d, F.lit(3)) < step, 2 / 3.0).otherwise(0.0) for d in range(3)]) for step in range(4)]
    return t.nation.select(k.alias("run"), F.posexplode(F.array(*points)).alias("step", "x"))


_START = ", ".join(f"(n_nationkey * {m}) % 4 / 3.0 + CASE WHEN (n_nationkey + {d}) % 3 < s THEN 2 / 3.0 ELSE 0 END" for d, m in enumerate((7, 5, 3)))
_WALKS = f"w AS (SELECT n_nationkey AS run, s AS step, [{_START}] AS x FROM nation, range(4) r(s))"
_APART = _WALKS + ", f AS (SELECT min(run) AS run FROM (SELECT run, list_sort(list(x)) AS shape FROM w GROUP BY 1) GROUP BY shape), u AS (SELECT w.* FROM w JOIN f USING (run)), d AS (SELECT a.run AS a, b.run AS b, round(sum(list_distance(a.x, b.x)), 9) AS distance FROM u a JOIN u b ON a.run <> b.run GROUP BY 1, 2)"


def _greedy_sql(size):
    """The groups as they grow, one step after the other."""
    parts = ["s0 AS (SELECT DISTINCT a AS start, [a] AS own, 0.0 AS total FROM d)"]
    for k in range(1, size):
        parts.append(f"s{k} AS (SELECT start, list_append(own, next) AS own, total + far AS total FROM (SELECT start, own, total, b AS next, sqrt(sum(distance * distance)) AS far FROM s{k - 1} JOIN d ON list_contains(own, a) WHERE NOT list_contains(own, b) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY start ORDER BY round(far, 6) DESC, next) = 1)")
    return ", ".join(parts)


query("sa_25", f"WITH {_APART}, {_greedy_sql(5)}, o AS (SELECT own FROM s4 ORDER BY round(total, 6) DESC, start LIMIT 1) SELECT CAST(k AS INT) AS place, own[k + 1] AS run FROM o, range(5) r(k)")(lambda t: calibration.spread_group(_walks(t), 5))
query("sa_25_distances", f"WITH {_APART} SELECT a, b, round(distance, 6) AS distance FROM d")(lambda t: calibration.trajectory_distances(_walks(t)).select("a", "b", F.round("distance", 6).alias("distance")))
query("sa_28")(lambda t: (lambda p, s: t.spark.createDataFrame([(float(p[0]), float(p[1]), s)], "x double, y double, score double"))(*calibration.shuffled_complexes(t.spark, lambda x: sampling.rosenbrock(*x), [-2, -2], [2, 2], rounds=25)))


def _evolved(t):
    """A population of 20 sets on a lattice after one round of evolution."""
    points = np.array([(-2 + k % 5, -2 + k // 5) for k in range(20)], float)
    score = lambda x: sampling.rosenbrock(*x)
    after, scores = calibration.evolve(t.spark, score, points, calibration.evaluate(t.spark, points, score), np.array([-2.0, -2.0]), np.array([2.0, 2.0]), 4, np.random.default_rng(1))
    return t.spark.createDataFrame([(k, *map(float, p), float(s)) for k, (p, s) in enumerate(zip(after, scores))], "k int, x double, y double, score double")


query("sa_29")(_evolved)
query("sa_31", "SELECT o_orderkey AS run, o_totalprice * 2 + 1 AS score FROM orders")(
    lambda t: calibration.run_models(t.orders.select(c("o_orderkey").alias("run"), "o_totalprice"), lambda r: r["o_totalprice"] * 2 + 1, t.spark.sparkContext.defaultParallelism)
)
query("sa_32", "SELECT p_partkey, rpad(p_name, 14, ' ') || lpad(printf('%.4f', p_retailprice), 14, ' ') AS line FROM part")(lambda t: t.part.select("p_partkey", F.concat(F.rpad("p_name", 14, " "), F.lpad(F.format_string("%.4f", "p_retailprice"), 14, " ")).alias("line")))
# A size has 50 values, so that all ways to cut a type's into four classes can be tried in SQL.
_FOUR = """WITH v AS (SELECT p_type, p_size AS x, CAST(sum(count(*)) OVER o AS DOUBLE) AS n, CAST(sum(count(*) * p_size) OVER o AS DOUBLE) AS s FROM part WHERE p_size IS NOT NULL GROUP BY 1, 2 WINDOW o AS (PARTITION BY p_type ORDER BY p_size)),
  w AS (SELECT a.p_type, a.x AS b1, b.x AS b2, c.x AS b3, d.x AS b4, a.s * a.s / a.n + (b.s - a.s) ** 2 / (b.n - a.n) + (c.s - b.s) ** 2 / (c.n - b.n) + (d.s - c.s) ** 2 / (d.n - c.n) AS held
    FROM v a JOIN v b ON b.p_type = a.p_type AND b.x > a.x JOIN v c ON c.p_type = a.p_type AND c.x > b.x JOIN (SELECT p_type, max(x) AS x, max(n) AS n, max(s) AS s FROM v GROUP BY 1) d ON d.p_type = a.p_type AND d.x > c.x)
SELECT p_type, CAST(b1 AS DOUBLE) AS b1, CAST(b2 AS DOUBLE) AS b2, CAST(b3 AS DOUBLE) AS b3, CAST(b4 AS DOUBLE) AS b4 FROM w QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY round(held, 6) DESC, b3, b2, b1) = 1"""
query("wn_23", _FOUR)(lambda t: calibration.natural_breaks(t.part, ["p_type"], "p_size", 4).select("p_type", *[c("breaks")[k].alias(f"b{k + 1}") for k in range(4)]))
# The same by blocks of eight values, as for groups whose distinct values are too many for a task.
query("wn_24", _FOUR)(lambda t: calibration.natural_breaks(t.part, ["p_type"], "p_size", 4, most=4, block=8).select("p_type", *[c("breaks")[k].alias(f"b{k + 1}") for k in range(4)]))
# With two classes, every cut can be tried in SQL.
query("wn_23_two", "WITH v AS (SELECT p_type, p_size AS x, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT a.p_type, a.x AS cut, sum(b.n) FILTER (WHERE b.x <= a.x) AS n1, sum(b.n * b.x) FILTER (WHERE b.x <= a.x) AS s1, sum(b.n) FILTER (WHERE b.x > a.x) AS n2, sum(b.n * b.x) FILTER (WHERE b.x > a.x) AS s2, max(b.x) AS top FROM v a JOIN v b USING (p_type) GROUP BY 1, 2) SELECT p_type, CAST(max_by(cut, (s1 * s1 / n1 + s2 * s2 / n2, -cut)) AS DOUBLE) AS lower, CAST(max(top) AS DOUBLE) AS upper FROM s WHERE n2 > 0 GROUP BY 1")(
    lambda t: calibration.natural_breaks(t.part, ["p_type"], "p_size", 2).select("p_type", c("breaks")[0].alias("lower"), c("breaks")[1].alias("upper"))
)

# Cells

query("gs_3", f"SELECT a.row, a.col, round(a.value - b.value, 6) AS value FROM {GRID} a JOIN {GRID} b ON a.row = b.row AND a.col = b.col + 1")(
    lambda t: (lambda g: g.join(g.select("row", (c("col") + 1).alias("col"), c("value").alias("other")), ["row", "col"]).select("row", "col", F.round(c("value") - c("other"), 6).alias("value")))(grid(t))
)


def _rasters(t):
    """Rasters of elevation, land use, soil, slope and sub-basin over the grid's cells; some cells lack a soil."""
    g = grid(t)
    return {
        "elevation": g.select("row", "col", c("value").alias("elevation")), "landuse": g.select("row", "col", F.floor(c("value") % 4).cast("int").alias("landuse")), "soil": g.where((c("row") + c("col")) % 9 != 0).select("row", "col", ((c("row") * 3 + c("col")) % 5).cast("int").alias("soil")),
        "slope": g.select("row", "col", F.when(c("value") > 200, 2).otherwise(1).alias("slope")), "subbasin": g.select("row", "col", F.expr("row div 10").cast("int").alias("subbasin")),
    }


_ZONES = f"SELECT row // 10 AS subbasin, CAST(floor(value % 4) AS INT) AS landuse, (row * 3 + col) % 5 AS soil, CASE WHEN value > 200 THEN 2 ELSE 1 END AS slope, value AS elevation FROM {GRID} WHERE (row + col) % 9 <> 0"
query("gs_9", f"SELECT subbasin, landuse, soil, slope, CAST(count(*) AS BIGINT) AS cells, round(sum(elevation), 4) AS elevation_sum, round(min(elevation), 4) AS lowest, round(max(elevation), 4) AS highest FROM ({_ZONES}) GROUP BY ALL")(
    lambda t: rounded(landunits.zonal(_rasters(t), ["subbasin", "landuse", "soil", "slope"], "elevation"))
)
query("gs_22", f"SELECT subbasin, CAST(count(*) AS BIGINT) AS cells, CAST(count(DISTINCT (landuse, soil, slope)) AS BIGINT) AS units, round(avg(elevation), 8) AS mean, round(min(elevation), 4) AS lowest, round(max(elevation), 4) AS highest, round(avg(CASE WHEN slope = 2 THEN 1.0 ELSE 0 END), 6) AS steep FROM ({_ZONES}) GROUP BY 1")(
    lambda t: (lambda z: rounded(z.groupBy("subbasin").agg(F.sum("cells").alias("cells"), F.count("*").alias("units"), (F.sum("elevation_sum") / F.sum("cells")).alias("mean"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), (F.sum(F.when(c("slope") == 2, c("cells")).otherwise(0)) / F.sum("cells")).alias("s")), 8)
    .join(z.groupBy("subbasin").agg(F.round(F.sum(F.when(c("slope") == 2, c("cells")).otherwise(0)) / F.sum("cells"), 6).alias("steep")), "subbasin").drop("s"))(landunits.zonal(_rasters(t), ["subbasin", "landuse", "soil", "slope"], "elevation"))
)
# Aquifers: one for each sub-basin and slope class, and a deep one for each sub-basin.
query("gs_23", f"SELECT subbasin, slope AS kind, CAST(count(*) AS BIGINT) AS cells, round(avg(elevation), 8) AS elevation FROM ({_ZONES}) GROUP BY 1, 2 UNION ALL SELECT subbasin, 0, count(*), round(avg(elevation), 8) FROM ({_ZONES}) GROUP BY 1")(
    lambda t: rounded(
        landunits.zonal(_rasters(t), ["subbasin", "slope", "soil"], "elevation").select("subbasin", F.explode(F.array(c("slope"), F.lit(0))).alias("kind"), "cells", "elevation_sum").groupBy("subbasin", "kind").agg(F.sum("cells").alias("cells"), (F.sum("elevation_sum") / F.sum("cells")).alias("elevation")), 8
    )
)


def _flow(t):
    """Cells that drain west and at column 0 north, as a network of numbers."""
    g = grid(t)
    node = c("row") * 100 + c("col")
    down = F.when(c("col") > 0, node - 1).when(c("row") > 0, node - 100)
    edges = g.select(node.alias("node"), down.alias("down"))
    return edges.join(edges.select(c("node").alias("down"), F.lit(True).alias("there")), "down", "left").select("node", F.when(c("there"), c("down")).alias("down"))


_CELLS = f"WITH RECURSIVE g AS (SELECT row * 100 + col AS node, CASE WHEN col > 0 THEN row * 100 + col - 1 WHEN row > 0 THEN row * 100 - 100 END AS down FROM {GRID}), e AS (SELECT a.node, a.down FROM g a JOIN g b ON a.down = b.node), r AS (SELECT node, down, 1 AS k FROM e UNION ALL SELECT r.node, e.down, k + 1 FROM r JOIN e ON r.down = e.node)"
query("gs_28", f"{_CELLS} SELECT node, CAST(1 + coalesce(n, 0) AS BIGINT) AS total FROM g LEFT JOIN (SELECT down AS x, count(*) AS n FROM r GROUP BY 1) ON x = node")(
    lambda t: (lambda e: network.upstream_sum(e.where("down is not null"), e.select("node", F.lit(1).cast("long").alias("n")), "n"))(_flow(t))
)
query("gs_32", f"{_CELLS} SELECT node, CAST(max(k) AS INT) AS steps FROM r GROUP BY 1")(lambda t: network.descend(_flow(t)).select("node", "steps"))
query("gs_8", f"{_CELLS} SELECT node, min_by(down, k) AS perimeter FROM r WHERE down % 7 = 0 GROUP BY 1")(lambda t: network.descend(_flow(t), lambda down: down % 7 == 0).select("node", c("target").alias("perimeter")))
query("gs_35", f"{_CELLS} SELECT node, max_by(down, k) AS ridge FROM r GROUP BY 1")(lambda t: network.descend(_flow(t)).select("node", c("target").alias("ridge")))
query("gs_33", f"SELECT row, col, CASE WHEN value > 400 THEN 2 WHEN value > 200 THEN 1 ELSE 0 END AS value FROM {GRID}")(lambda t: landunits.map_one(grid(t), lambda x: F.when(x > 400, 2).when(x > 200, 1).otherwise(0)))
query("gs_34", f"SELECT row, col, CASE WHEN (CASE WHEN CAST(trunc(value + 10) AS INT) = 0 THEN 0 ELSE value / (value + 10) END) <= 0.95 THEN 1 ELSE 0 END AS value FROM {GRID}")(lambda t: landunits.slope_position(grid(t), grid(t).withColumn("value", F.lit(10.0)), 0.95))
query("gs_38", f"SELECT a.grid_row, a.grid_col, a.n, b.n AS west FROM (SELECT row // 5 AS grid_row, CAST(col // 5 AS BIGINT) AS grid_col, count(*) AS n FROM {GRID} GROUP BY 1, 2) a LEFT JOIN (SELECT row // 5 AS grid_row, CAST(col // 5 AS BIGINT) + 1 AS grid_col, count(*) AS n FROM {GRID} GROUP BY 1, 2) b USING (grid_row, grid_col)")(
    lambda t: (lambda g: g.join(g.select("grid_row", (c("grid_col") + 1).alias("grid_col"), c("n").alias("west")), ["grid_row", "grid_col"], "left").select("grid_row", "grid_col", "n", "west"))(
        grid(t).groupBy(F.expr("row div 5").alias("grid_row"), F.expr("col div 5").alias("grid_col")).agg(F.count("*").alias("n"))
    )
)

# Inserts that reports are made from

query("rp_17", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda t: t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey")).select("s_suppkey", "n_name", "r_name")
)
query("rp_22", "SELECT p_partkey, CASE WHEN p_size < 3 THEN 121 WHEN p_size < 8 THEN 60 ELSE 10 END AS length, p_size / sum(p_size) OVER (PARTITION BY p_brand) AS share FROM part")(
    lambda t: t.part.select("p_partkey", F.when(c("p_size") < 3, 121).when(c("p_size") < 8, 60).otherwise(10).alias("length"), (c("p_size") / F.sum("p_size").over(Window.partitionBy("p_brand"))).alias("share"))
)
for _number, _prefix in ((23, "cha"), (24, "res"), (25, "rec")):
    query(f"rp_{_number}", f"SELECT p_partkey AS id, '{_prefix}' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS name, p_size AS area FROM part WHERE p_size > 40")(
        lambda t, prefix=_prefix: t.part.where("p_size > 40").select(c("p_partkey").alias("id"), F.concat(F.lit(prefix), F.lpad(c("p_partkey").cast("string"), 6, "0")).alias("name"), c("p_size").alias("area"))
    )
query("rp_26", "SELECT s_nationkey AS aquifer, min(s_suppkey) AS outlet, round(sum(s_acctbal), 4) AS area FROM supplier GROUP BY 1")(lambda t: t.supplier.groupBy(c("s_nationkey").alias("aquifer")).agg(F.min("s_suppkey").alias("outlet"), F.round(F.sum("s_acctbal"), 4).alias("area")))
query("rp_28", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 24 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region")(
    lambda t: (lambda old: relational.replace(old, t.region.crossJoin(F.broadcast(t.nation.agg(F.max("n_nationkey").alias("top")))).select((c("top") + F.row_number().over(Window.partitionBy("top").orderBy("r_regionkey"))).alias("id"), c("r_name").alias("name")), ["id"]))(
        t.nation.where("n_regionkey <> 1").select(c("n_nationkey").alias("id"), c("n_name").alias("name"))
    )
)
# Reservoirs: suppliers; those with a rule for their nation get it, those in debt a drained one, all others keep theirs.
query("rp_29", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'drawdown' WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'rule_' || s_nationkey ELSE 'default' END AS release FROM supplier")(
    lambda t: (lambda res: relational.update_where(relational.update_from(res, t.nation.where("n_regionkey = 2").select(c("n_nationkey").alias("s_nationkey"), F.concat(F.lit("rule_"), c("n_nationkey").cast("string")).alias("release")), ["s_nationkey"], ["release"]), c("s_acctbal") < 0, release="drawdown").select("s_suppkey", "release"))(
        t.supplier.withColumn("release", F.lit("default"))
    )
)
