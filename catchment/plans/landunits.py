"""Land units from line items: supplier's nation as unit, part type as crop, brand as soil, flag as slope."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catchment.operators import landunits as lu
from catchment.operators.aggregates import dominant
from catchment.operators.nearest import nearest, nearest_of_list
from catchment.operators.relational import pairs_of_key
from catchment.plans.registry import query


def c(name):
    return F.col(name)


def units(t):
    joined = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).join(t.supplier, c("l_suppkey") == c("s_suppkey"))
    return joined.groupBy(c("s_nationkey").alias("unit"), c("p_type").alias("crop"), F.substring("p_brand", 1, 7).alias("soil"), c("l_returnflag").alias("slope")).agg(F.sum("l_quantity").alias("area"))


UNITS = "u AS (SELECT s_nationkey AS unit, p_type AS crop, substr(p_brand, 1, 7) AS soil, l_returnflag AS slope, sum(l_quantity) AS area FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4)"


def rounded(df, digits=4):
    return df.select(*[F.round(x, digits).alias(x) if kind == "double" else c(x) for x, kind in df.dtypes])


def cells(t):
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        c("l_suppkey").alias("unit"), "p_type", c("l_partkey").alias("cell"), c("l_quantity").alias("area"), c("p_size").cast("double").alias("elevation"), c("l_extendedprice").alias("distance")
    )


query("ag_42", "SELECT l_suppkey AS unit, p_type, CAST(count(*) AS BIGINT) AS cells, round(sum(l_quantity), 4) AS area, round(sum(p_size * l_quantity), 4) AS elevation_area, CAST(min(p_size) AS DOUBLE) AS lowest, CAST(max(p_size) AS DOUBLE) AS highest, max_by(l_partkey, (l_extendedprice, -l_partkey)) AS farthest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")(
    lambda t: rounded(lu.accumulate(cells(t), ["unit", "p_type"]))
)
for _number, _key in ((43, "crop"), (44, "soil"), (45, "slope")):
    query(f"ag_{_number}", f"WITH {UNITS} SELECT unit, {_key}, round(sum(area), 4) AS area FROM u GROUP BY 1, 2")(lambda t, key=_key: rounded(units(t).groupBy("unit", key).agg(F.sum("area").alias("area"))))
query("ag_46", f"WITH {UNITS} SELECT unit, crop, round(sum(area), 4) AS area FROM u GROUP BY ROLLUP (unit, crop)")(lambda t: rounded(lu.areas(units(t), "crop")))
for _number, _key in ((47, "crop"), (48, "soil"), (49, "slope"), (50, "unit")):
    query(f"ag_{_number}", f"WITH {UNITS} SELECT {_key}, round(sum(area), 4) AS area FROM u GROUP BY 1")(lambda t, key=_key: rounded(units(t).groupBy(key).agg(F.sum("area").alias("area"))))
query("ag_51", f"WITH {UNITS} SELECT unit, crop, round(area, 4) AS area FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY area DESC, crop) AS k FROM (SELECT unit, crop, sum(area) AS area FROM u GROUP BY 1, 2)) WHERE k = 1")(
    lambda t: rounded(dominant(units(t), ["unit"], ["crop"], "area"))
)
for _name in ("ag_52", "gs_10"):
    query(_name, f"WITH {UNITS} SELECT unit, crop, soil, slope, round(whole, 4) AS area FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY area DESC, crop, soil, slope) AS k, sum(area) OVER (PARTITION BY unit) AS whole FROM u) WHERE k = 1")(lambda t: rounded(lu.dominant_units(units(t))))
query("ag_55", "SELECT p_brand, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE p_size > {5 * k} AND p_size <= {5 * k + 5}) / count(*), 6) AS band_{k + 1}" for k in range(10)) + " FROM part GROUP BY 1")(
    lambda t: t.part.groupBy("p_brand").agg(*[F.round(100.0 * F.count_if((c("p_size") > 5 * k) & (c("p_size") <= 5 * k + 5)) / F.count("*"), 6).alias(f"band_{k + 1}") for k in range(10)])
)
query("ag_56", f"WITH {UNITS}, s(crop, sub, percent) AS (VALUES ('SMALL', 'SMALL_A', 30.0), ('SMALL', 'SMALL_B', 70.0)) SELECT unit, coalesce(sub, u.crop) AS crop, soil, slope, round(area * coalesce(CAST(percent AS DOUBLE) / 100, 1), 4) AS area FROM u LEFT JOIN s ON u.crop = s.crop")(
    lambda t: rounded(lu.split(units(t), t.spark.createDataFrame([("SMALL", "SMALL_A", 30.0), ("SMALL", "SMALL_B", 70.0)], "crop string, sub string, percent double")))
)
query("gs_11", f"WITH {UNITS}, " + ", ".join(f"{k} AS (SELECT unit, {k} FROM (SELECT unit, {k}, row_number() OVER (PARTITION BY unit ORDER BY sum(area) DESC, {k}) AS n FROM u GROUP BY 1, 2) WHERE n = 1)" for k in lu.KEYS).replace("crop AS (", "dc AS (").replace("soil AS (", "ds AS (").replace("slope AS (", "dl AS (") + " SELECT unit, round(a, 4) AS area, crop, soil, slope FROM (SELECT unit, sum(area) AS a FROM u GROUP BY 1) JOIN dc USING (unit) JOIN ds USING (unit) JOIN dl USING (unit)")(
    lambda t: rounded(lu.dominant_each(units(t)))
)


def _staged(crop, soil, slope, percent):
    """The three stages, each as one more layer of SQL."""
    def stage(source, by, key, limit):
        bound = f"whole * {limit} / 100" if percent else str(limit)
        return f"(SELECT unit, crop, soil, slope, area * whole / sum(area) OVER (PARTITION BY {by}) AS area FROM (SELECT *, max(part) OVER (PARTITION BY {by}) AS top FROM (SELECT *, sum(area) OVER (PARTITION BY {by}, {key}) AS part, sum(area) OVER (PARTITION BY {by}) AS whole FROM {source})) WHERE part >= least({bound}, top))"

    return f"WITH {UNITS} SELECT unit, crop, soil, slope, round(area, 4) AS area FROM " + stage(stage(stage("u", "unit", "crop", crop), "unit, crop", "soil", soil), "unit, crop, soil", "slope", slope)


query("gs_13", _staged(17, 21, 30, True))(lambda t: rounded(lu.threshold(units(t), 17, 21, 30)))
query("gs_14", _staged(9000, 2000, 700, False))(lambda t: rounded(lu.threshold(units(t), 9000, 2000, 700, percent=False)))
for _number, _key in ((15, "crop"), (16, "soil"), (17, "slope")):
    query(f"gs_{_number}", f"WITH {UNITS} SELECT round(min(top), 6) AS \"limit\" FROM (SELECT unit, max(part / whole * 100) AS top FROM (SELECT unit, {_key}, sum(area) AS part, sum(sum(area)) OVER (PARTITION BY unit) AS whole FROM u GROUP BY 1, 2) GROUP BY 1)")(
        lambda t, key=_key: rounded(lu.crop_limit(units(t), key), 6)
    )
# One part at a time: the m smallest are gone, and what is left has grown by f.
query(
    "gs_12",
    f"""WITH RECURSIVE {UNITS}, k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY area, crop, soil, slope) AS r, count(*) OVER (PARTITION BY unit) AS n, sum(area) OVER (PARTITION BY unit) AS whole FROM u),
    g(unit, m, f) AS (SELECT DISTINCT unit, 0, CAST(1 AS DOUBLE) FROM u UNION ALL SELECT g.unit, m + 1, f * whole / (whole - area * f) FROM g JOIN k ON k.unit = g.unit AND r = m + 1 AND r < n WHERE area * f < 300)
    SELECT unit, crop, soil, slope, round(area * f, 4) AS area FROM k JOIN (SELECT unit, max(m) AS m, max_by(f, m) AS f FROM g GROUP BY 1) USING (unit) WHERE r > m""",
)(lambda t: rounded(lu.remove_smallest(units(t), 300.0)))
query("st_14", f"WITH {UNITS}, k AS (SELECT *, row_number() OVER (ORDER BY area, unit, crop, soil, slope) AS n, sum(area) OVER (PARTITION BY unit) AS whole FROM u) SELECT unit, crop, soil, slope, round(area * whole / sum(area) OVER (PARTITION BY unit), 4) AS area FROM k WHERE n > (SELECT count(*) - 900 FROM u)")(
    lambda t: rounded(lu.remove_to_target(units(t), 900))
)
query("gs_18", f"WITH {UNITS} SELECT unit, crop, soil, slope, round(area * 1.5, 4) AS area FROM u")(lambda t: rounded(units(t).withColumn("area", c("area") * 1.5)))
query("gs_19", f"WITH {UNITS} SELECT unit, crop, soil, slope, round(area * whole / sum(area) OVER (PARTITION BY unit), 4) AS area FROM (SELECT *, sum(area) OVER (PARTITION BY unit) AS whole FROM u) WHERE crop <> 'PROMO'")(lambda t: rounded(lu.redistribute(units(t), c("crop") == "PROMO")))
query("gs_20", f"WITH {UNITS} SELECT unit // 5 AS unit, crop, soil, slope, round(sum(area), 4) AS area FROM u GROUP BY 1, 2, 3, 4")(
    lambda t: rounded(lu.merge(units(t), t.nation.select(c("n_nationkey").alias("unit"), F.expr("cast(n_nationkey div 5 as int)").alias("target"))))
)
query("gs_21", f"WITH {UNITS} SELECT unit, crop, round(sum(area) / sum(sum(area)) OVER (PARTITION BY unit), 8) AS share FROM u GROUP BY 1, 2")(
    lambda t: (lambda d: d.join(d.groupBy("unit").agg(F.sum("area").alias("whole")), "unit").select("unit", "crop", F.round(c("area") / c("whole"), 8).alias("share")))(units(t).groupBy("unit", "crop").agg(F.sum("area").alias("area")))
)
query("gs_39", "SELECT p_partkey FROM part WHERE p_size * 1e4 < (SELECT avg(p_size * 1e4) * 0.4 FROM part)")(
    lambda t: t.part.crossJoin(F.broadcast(t.part.agg((F.avg(c("p_size") * 1e4) * 0.4).alias("cut")))).where(c("p_size") * 1e4 < c("cut")).select("p_partkey")
)

# Run-length lists of ordinals

query("snk_6", "SELECT p_brand, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',-' || b END, ',' ORDER BY a) AS elements FROM (SELECT p_brand, min(p_size) AS a, max(p_size) AS b FROM (SELECT *, p_size - row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM (SELECT DISTINCT p_brand, p_size FROM part)) GROUP BY p_brand, i) GROUP BY 1")(
    lambda t: lu.runs(t.part, ["p_brand"], "p_size")
)

# Rasters: events make a grid (user by hour of day), values their means

GRID = "(SELECT user_id AS row, CAST(hour(ts) AS INT) AS col, max(value) AS value FROM events GROUP BY 1, 2)"


def grid(t):
    return t.events.groupBy(c("user_id").alias("row"), F.hour("ts").alias("col")).agg(F.max("value").alias("value"))


query("gs_1", f"SELECT row, col, CASE WHEN col <> 3 THEN round(ln(value + 1), 8) END AS value FROM {GRID}")(lambda t: lu.map_one(grid(t).withColumn("value", F.when(c("col") == 3, -1.0).otherwise(c("value"))), lambda x: F.round(F.ln(x + 1), 8), -1.0))
query("gs_2", f"SELECT a.row, a.col, round(a.value - b.value, 6) AS value FROM {GRID} a JOIN {GRID} b USING (row, col)")(lambda t: lu.map_two(grid(t), grid(t), lambda a, b: F.round(a - b, 6)))
query("gs_4", f"SELECT row, col, CASE WHEN col % 2 = 0 THEN value END AS value FROM {GRID}")(lambda t: grid(t).select("row", "col", F.when(c("col") % 2 == 0, c("value")).alias("value")))
query("gs_5", f"SELECT row, col, 1000 + col * 30 + 15 AS x, 5000 - row * 30 - 15 AS y FROM {GRID}")(lambda t: grid(t).select("row", "col", (1000 + c("col") * 30 + 15).alias("x"), (5000 - c("row") * 30 - 15).alias("y")))
query("gs_6", f"SELECT row, col, row + [0, -1, -1, -1, 0, 1, 1, 1][col % 8 + 1] AS down_row, CAST(col + [1, 1, 0, -1, -1, -1, 0, 1][col % 8 + 1] AS INT) AS down_col FROM {GRID}")(lambda t: lu.downstream_cell(grid(t).withColumn("value", c("col") % 8 + 1)))
query("gs_7", f"SELECT row, col, CASE WHEN col IN (4, 5) THEN value - 20 ELSE value END AS value FROM {GRID}")(lambda t: grid(t).withColumn("value", F.when(c("col").isin(4, 5), c("value") - 20).otherwise(c("value"))))
query("gs_27", f"WITH g AS {GRID}, d(k, r, q) AS (VALUES (1, 0, 1), (2, -1, 1), (3, -1, 0), (4, -1, -1), (5, 0, -1), (6, 1, -1), (7, 1, 0), (8, 1, 1)) SELECT row, col, CAST(max_by(k, (drp, -k)) AS INT) AS value FROM (SELECT a.row, a.col, k, (a.value - b.value) / CASE WHEN k % 2 = 1 THEN 1.0 ELSE sqrt(2.0) END AS drp FROM g a, d JOIN g b ON true WHERE b.row = a.row + r AND b.col = a.col + q) WHERE drp > 0 GROUP BY 1, 2")(
    lambda t: lu.steepest(grid(t))
)
query("gs_29", f"SELECT row, col, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS value FROM {GRID}")(lambda t: grid(t).select("row", "col", F.when(c("value") >= 100, 1).otherwise(0).alias("value")))
query("gs_36", f"SELECT row, col, CASE WHEN (CASE WHEN CAST(trunc(value + col) AS INT) = 0 THEN 0 ELSE value / (value + col) END) <= 0.9 THEN 1 ELSE 0 END AS value FROM {GRID}")(
    lambda t: lu.slope_position(grid(t), grid(t).withColumn("value", c("col").cast("double")), 0.9)
)
query("gs_37", f"SELECT row // 5 AS grid_row, CAST(col // 5 AS BIGINT) AS grid_col, CAST(count(*) FILTER (WHERE value > 60) AS BIGINT) AS count, CAST(max_by(row * 100 + col, (value, -row, -col)) AS BIGINT) AS drain FROM {GRID} GROUP BY 1, 2")(
    lambda t: lu.grid_cells(grid(t).withColumn("value", c("value") - 60), 5).select("grid_row", "grid_col", "count", (c("drain.row") * 100 + c("drain.col")).alias("drain"))
)

# Nearest stations: vectors give coordinates

_NEAR = "SELECT id, min_by(station, (d2, station)) AS station, round(min(d2), 8) AS d2 FROM (SELECT v.vec_id AS id, s_suppkey AS station, pow(CAST(v.embedding[1] AS DOUBLE) - (s_nationkey - 12) / 12.0, 2) * {} + pow(CAST(v.embedding[2] AS DOUBLE) - (s_acctbal - 4500) / 5500.0, 2) AS d2 FROM embeddings v, supplier) GROUP BY 1"


def _points(t):
    points = t.embeddings.select(c("vec_id").alias("id"), c("embedding")[0].cast("double").alias("x"), c("embedding")[1].cast("double").alias("y"))
    return points, t.supplier.select(c("s_suppkey").alias("station"), ((c("s_nationkey") - 12) / 12.0).alias("sx"), ((c("s_acctbal") - 4500) / 5500.0).alias("sy"))


query("jn_27", _NEAR.format("1"))(lambda t: nearest(*_points(t)).withColumn("d2", F.round("d2", 8)))
query("jn_27_cells", _NEAR.format("1"))(lambda t: nearest(*_points(t), small=0).withColumn("d2", F.round("d2", 8)))
query("jn_28", _NEAR.format("pow(cos(radians(CAST(v.embedding[2] AS DOUBLE))), 2)"))(lambda t: nearest(*_points(t), weighted=True).withColumn("d2", F.round("d2", 8)))
# Nearest vertex: of lines, each a nation's suppliers in order, the vertex's place in its line and the line.
query("jn_29", f"SELECT id, s_nationkey AS line, CAST(k AS INT) AS vertex, d2 FROM ({_NEAR.format('1')}) JOIN (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) ON s_suppkey = station")(
    lambda t: nearest(*_points(t)).join(t.supplier.select("s_suppkey", c("s_nationkey").alias("line"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("vertex")), c("station") == c("s_suppkey")).select("id", "line", "vertex", F.round("d2", 8).alias("d2"))
)
# Nearest of a point list: each point's own list are the suppliers of the nation of its number.
query("jn_30", "SELECT id, min_by(station, (d2, station)) AS station, round(min(d2), 8) AS d2 FROM (SELECT v.vec_id AS id, s_suppkey AS station, pow(CAST(v.embedding[1] AS DOUBLE) - (s_nationkey - 12) / 12.0, 2) + pow(CAST(v.embedding[2] AS DOUBLE) - (s_acctbal - 4500) / 5500.0, 2) AS d2 FROM embeddings v JOIN supplier ON s_nationkey = vec_id % 25) GROUP BY 1")(
    lambda t: nearest_of_list(_points(t)[0].withColumn("list", c("id") % 25), _points(t)[1].join(t.supplier.select(c("s_suppkey").alias("station"), c("s_nationkey").alias("list")), "station"), "list").withColumn("d2", F.round("d2", 8))
)
query("jn_31", f"SELECT * FROM ({_NEAR.format('1')}) WHERE d2 <= 0.0001")(lambda t: nearest(*_points(t), limit=0.01).withColumn("d2", F.round("d2", 8)))
# A box begins at a multiple of 8 and is 2 wide, so a value's only box size is its eighth, rounded down.
query("jn_39", "SELECT e.event_id, b.id FROM events e JOIN (SELECT p_partkey AS id, p_size * 8.0 AS lo, p_size * 8.0 + 2 AS hi FROM part) b ON value BETWEEN lo AND hi")(
    lambda t: pairs_of_key(
        t.events.withColumn("size", F.floor(c("value") / 8)).where(c("value") <= c("size") * 8.0 + 2), t.part.select(c("p_partkey").alias("id"), c("p_size").cast("long").alias("size")), "size", "event_id", "id"
    )
)
query("jn_40", "SELECT event_id, CAST(floor(value / 25) AS BIGINT) AS cell FROM events")(lambda t: t.events.select("event_id", F.floor(c("value") / 25).alias("cell")))
