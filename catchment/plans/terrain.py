"""Terrain of the events' grid (user by hour of day): regions of value classes, filled pits, streams, lakes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.operators import lakes, terrain
from catchment.operators import landunits as lu
from catchment.operators.iterate import cut, fresh_path
from catchment.plans.landunits import GRID, grid
from catchment.plans.registry import query
from catchment.sources import raster


def c(name):
    return F.col(name)


KEY = "(CAST(row AS BIGINT) * 2147483648 + col)"
_CLASSES = f"g AS MATERIALIZED (SELECT {KEY} AS k, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(floor(value / 100) AS INT) AS value FROM {GRID})"
_SAME = "p AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.value = b.value AND abs(a.row - b.row) + abs(a.col - b.col) = 1)"
# The least key of each region spreads along its pairs of neighbours until none gets less.
_LABELS = """r(k, root) USING KEY (k) AS (
  SELECT k, k FROM g
  UNION SELECT p.b, min(r.root) FROM r JOIN p ON p.a = r.k JOIN recurring.r o ON o.k = p.b WHERE r.root < o.root GROUP BY p.b)"""


def classes(t):
    return grid(t).select("row", "col", F.floor(c("value") / 100).cast("int").alias("value"))


# Holes by Euler's number: cells less pairs of neighbours and plus full squares are one less the holes.
query(
    "gs_25",
    f"""WITH RECURSIVE {_CLASSES}, {_SAME}, {_LABELS},
    l AS (SELECT row, col, root FROM g JOIN r USING (k)),
    n AS (SELECT root, count(*) AS n FROM l GROUP BY 1),
    e AS (SELECT a.root, count(*) AS e FROM l a JOIN l b ON a.root = b.root AND (b.row - a.row, b.col - a.col) IN ((0, 1), (1, 0)) GROUP BY 1),
    q AS (SELECT a.root, count(*) AS q FROM l a JOIN l b ON a.root = b.root AND b.row = a.row AND b.col = a.col + 1
      JOIN l x ON a.root = x.root AND x.row = a.row + 1 AND x.col = a.col JOIN l y ON a.root = y.root AND y.row = a.row + 1 AND y.col = a.col + 1 GROUP BY 1)
    SELECT root AS region, CAST(n AS BIGINT) AS area, CAST(4 * n - 2 * coalesce(e, 0) AS BIGINT) AS perimeter, CAST(1 - (n - coalesce(e, 0) + coalesce(q, 0)) AS BIGINT) AS holes
    FROM n LEFT JOIN e USING (root) LEFT JOIN q USING (root)""",
)(lambda t: terrain.polygons(terrain.outlines(terrain.regions(classes(t)).select("row", "col", "region"))).select("region", "area", "perimeter", "holes"))

_STEPS = "d(r, q) AS (VALUES (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))"
# Levels only sink: a cell's is the least, over its neighbours, of the greater of their level and its own height.
query(
    "gs_26",
    f"""WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {GRID}), {_STEPS},
    n AS MATERIALIZED (SELECT a.row, a.col, b.row AS row2, b.col AS col2, b.value AS z FROM g a CROSS JOIN d JOIN g b ON b.row = a.row + r AND b.col = a.col + q),
    f(row, col, level) USING KEY (row, col) AS (
      SELECT g.row, g.col, value FROM g LEFT JOIN n USING (row, col) GROUP BY ALL HAVING count(z) < 8
      UNION SELECT n.row2, n.col2, min(greatest(n.z, f.level)) FROM f JOIN n ON n.row = f.row AND n.col = f.col
        LEFT JOIN recurring.f o ON o.row = n.row2 AND o.col = n.col2 WHERE greatest(n.z, f.level) < coalesce(o.level, 1e308) GROUP BY 1, 2)
    SELECT row, col, value, level AS filled FROM g JOIN f USING (row, col)""",
)(lambda t: terrain.fill_pits(grid(t)))


def drained(t):
    """node, down, z, step: each cell and the neighbour of the steepest descent from it."""
    cells = grid(t)
    ways = lu.downstream_cell(lu.steepest(cells))
    key = terrain.cell_key(c("row"), c("col"))
    ways = ways.select("row", "col", terrain.cell_key(c("down_row"), c("down_col")).alias("down"), F.when((c("row") == c("down_row")) | (c("col") == c("down_col")), 1.0).otherwise(2**0.5).alias("step"))
    return cut(cells.join(ways, ["row", "col"], "left").select(key.alias("node"), "down", c("value").alias("z"), F.coalesce("step", F.lit(1.0)).alias("step")))


_DRAINED = f"""g AS MATERIALIZED (SELECT {KEY} AS k, row, col, value FROM {GRID}),
  d(n, r, q) AS (VALUES (1, 0, 1), (2, -1, 1), (3, -1, 0), (4, -1, -1), (5, 0, -1), (6, 1, -1), (7, 1, 0), (8, 1, 1)),
  falls AS (SELECT a.k, n, b.k AS down, (a.value - b.value) / CASE WHEN n % 2 = 1 THEN 1 ELSE sqrt(2) END AS fall, CASE WHEN n % 2 = 1 THEN 1 ELSE sqrt(2) END AS step
    FROM g a CROSS JOIN d JOIN g b ON b.row = a.row + r AND b.col = a.col + q WHERE a.value > b.value),
  e AS MATERIALIZED (SELECT g.k AS node, w.down, value AS z, step FROM g LEFT JOIN (SELECT k, max_by(down, (fall, -n)) AS down, max_by(step, (fall, -n)) AS step FROM falls GROUP BY 1) w USING (k)),
  walk(node, pos) AS (SELECT node, node FROM e UNION ALL SELECT walk.node, down FROM walk JOIN e ON e.node = pos WHERE down IS NOT NULL),
  wet AS MATERIALIZED (SELECT e.* FROM e JOIN (SELECT pos AS node FROM walk GROUP BY 1 HAVING count(*) >= 3) USING (node)),
  ups AS MATERIALIZED (SELECT down AS node, count(*) AS n FROM wet WHERE down IS NOT NULL GROUP BY 1),
  m(link, node, place) AS (SELECT node, node, 0 FROM wet LEFT JOIN ups USING (node) WHERE n IS NULL OR n > 1
    UNION ALL SELECT link, w.down, place + 1 FROM m JOIN wet w USING (node) JOIN ups u ON u.node = w.down WHERE u.n = 1),
  ends AS MATERIALIZED (SELECT link, max_by(node, place) AS last, count(*) AS cells, coalesce(sum(step) FILTER (WHERE down IS NOT NULL), 0) AS length, min_by(z, place) - max_by(z, place) AS drop
    FROM m JOIN wet USING (node) GROUP BY 1),
  links AS MATERIALIZED (SELECT ends.*, m.link AS down FROM ends JOIN wet ON wet.node = last LEFT JOIN m ON m.node = wet.down)"""
query(
    "gs_30",
    f"""WITH RECURSIVE {_DRAINED},
    s(link, o) USING KEY (link) AS (SELECT link, 1 FROM links
      UNION SELECT x.link, x.o FROM (SELECT link, all_[1] + CASE WHEN all_[1] = all_[2] THEN 1 ELSE 0 END AS o
          FROM (SELECT l.down AS link, list(v.o ORDER BY v.o DESC) AS all_ FROM links l JOIN recurring.s v ON v.link = l.link
            JOIN (SELECT DISTINCT k.down FROM links k JOIN s ON s.link = k.link) w ON w.down = l.down GROUP BY 1)) x
        JOIN recurring.s y ON y.link = x.link WHERE x.o > y.o)
    SELECT link, last, down, CAST(cells AS BIGINT) AS cells, round(length, 6) AS length, round(drop, 4) AS drop, o AS strahler FROM links JOIN s USING (link)""",
)(lambda t: terrain.stream_links(drained(t), 3)[1].select("link", "last", "down", "cells", F.round("length", 6).alias("length"), F.round("drop", 4).alias("drop"), "strahler"))
query("gs_30_cells", f"WITH RECURSIVE {_DRAINED} SELECT node, link, place FROM m")(lambda t: terrain.stream_cells(drained(t), 3).select("node", "link", "place"))


def outlets(t):
    return t.customer.select(c("c_custkey").alias("point"), terrain.cell_key(c("c_custkey") % 150, c("c_nationkey") % 24).alias("node"))


query(
    "gs_31",
    f"""WITH RECURSIVE {_DRAINED},
    o AS (SELECT c_custkey AS point, c_custkey % 150 * 2147483648 + c_nationkey % 24 AS node FROM customer),
    t(point, node, pos, steps) AS (SELECT point, node, node, 0 FROM o
      UNION ALL SELECT point, t.node, e.down, steps + 1 FROM t JOIN e ON e.node = t.pos WHERE e.down IS NOT NULL AND t.pos NOT IN (SELECT node FROM wet))
    SELECT o.point, o.node, pos AS moved, steps FROM o LEFT JOIN (SELECT point, pos, steps FROM t WHERE pos IN (SELECT node FROM wet)) USING (point)""",
)(lambda t: terrain.move_to_streams(outlets(t), *(lambda d: (d, terrain.stream_cells(d, 3)))(drained(t))))


def outlined(t):
    """The regions' sides as sides of polygons, which are drawn in any order."""
    points = terrain.sides(terrain.regions(classes(t)).select("row", "col", "region"))
    ends = {"x1": "col", "y1": "row", "x2": "next_col", "y2": "next_row"}
    return points.select(c("region").alias("polygon"), c("region").alias("value"), *[c(v).cast("double").alias(k) for k, v in ends.items()])


# Regions drawn from their outlines are the regions again.
query("snk_31", f"WITH RECURSIVE {_CLASSES}, {_SAME}, {_LABELS} SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, root AS value FROM g JOIN r USING (k)")(lambda t: terrain.rasterise(outlined(t)))


def stored_raster(t):
    """The grid written as a raster of as many rows as there are users, and read back, missing cells as nulls."""
    size = t.events.agg(F.coalesce(F.max("user_id") + 1, F.lit(0)).alias("rows")).first()["rows"]
    path = fresh_path(t.spark, "raster")
    raster.write_raster(grid(t), path, size, 24)
    return raster.read_raster(t.spark, path).select("row", "col", F.round(c("value").cast("double"), 3).alias("value"))


query(
    "src_30",
    f"SELECT CAST(r AS INT) AS row, CAST(q AS INT) AS col, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value FROM range((SELECT max(user_id) + 1 FROM events)) a(r), range(24) b(q) LEFT JOIN {GRID} ON row = r AND col = q",
)(stored_raster)


def lake_table(t):
    """node, lake, playa: a lake of three by four cells for each supplier, every fifth nation's playas."""
    box = t.supplier.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    key = terrain.cell_key(F.expr("s_suppkey * 3 div 2") + c("r"), c("s_suppkey") * 7 % 21 + c("q"))
    return box.select(key.alias("node"), c("s_suppkey").alias("lake"), (c("s_nationkey") % 5 == 0).alias("playa"))


def network_with_areas(t):
    """node, down, link, place, z, area: the stream cells with what drains through them."""
    return terrain.stream_cells(drained(t), 3).select("node", "down", "link", "place", "z", "area")


_LAKES = f"""{_DRAINED},
  lt AS MATERIALIZED (SELECT (s_suppkey * 3 // 2 + r) * 2147483648 + s_suppkey * 7 % 21 + q AS node, s_suppkey AS lake, s_nationkey % 5 = 0 AS playa FROM supplier, range(3) a(r), range(4) b(q)),
  lk AS MATERIALIZED (SELECT node, max(lake) AS lake FROM lt WHERE NOT playa GROUP BY 1),
  areas AS (SELECT pos AS node, count(*) AS area FROM walk GROUP BY 1),
  x AS (SELECT m.link, m.node, place, w.down, w.z, area, lake, place - row_number() OVER (PARTITION BY m.link, lake ORDER BY place) AS run
    FROM m JOIN wet w USING (node) JOIN areas USING (node) LEFT JOIN lk USING (node)),
  y AS MATERIALIZED (SELECT *, first_value(node) OVER (PARTITION BY link, lake, run ORDER BY place) AS reach FROM x),
  n AS MATERIALIZED (SELECT r.*, y.reach AS nxt, y.lake AS nlake
    FROM (SELECT reach, link, lake, area, z, node AS last, down, count(*) OVER (PARTITION BY reach) AS cells FROM y QUALIFY row_number() OVER (PARTITION BY reach ORDER BY place DESC) = 1) r LEFT JOIN y ON y.node = r.down),
  main AS MATERIALIZED (SELECT * FROM n WHERE lake IS NOT NULL AND nlake IS DISTINCT FROM lake QUALIFY row_number() OVER (PARTITION BY lake ORDER BY area DESC, last) = 1),
  size AS (SELECT lake, count(*) AS size FROM lk GROUP BY 1),
  taken AS MATERIALIZED (SELECT n.reach, min(main.lake) AS taker, min(n.nxt) AS onward FROM main JOIN size ON size.lake = main.lake JOIN n ON n.reach = main.nxt
    LEFT JOIN (SELECT nxt, sum(area) AS inflow FROM n GROUP BY 1) i ON i.nxt = n.reach
    WHERE n.lake IS NULL AND n.nxt IS NOT NULL AND n.nlake IS NULL GROUP BY n.reach HAVING count(*) = 1 AND min(n.area - coalesce(inflow, 0)) < 0.5 * max(size)),
  fin AS MATERIALIZED (SELECT n.*, coalesce(n.lake, a.taker) AS inside, coalesce(nlake, b.taker) AS ninside FROM n LEFT JOIN taken a ON a.reach = n.reach LEFT JOIN taken b ON b.reach = n.nxt),
  outs AS MATERIALIZED (SELECT main.lake, main.last, main.z, coalesce(a.onward, main.nxt) AS nxt, f.inside AS ninside FROM main LEFT JOIN taken a ON a.reach = main.nxt LEFT JOIN fin f ON f.reach = coalesce(a.onward, main.nxt))"""
_SINK = "CASE WHEN nxt IS NULL THEN 'X' WHEN ninside IS NOT NULL THEN 'RES' ELSE 'CH' END AS sink_cat, CASE WHEN nxt IS NULL THEN last ELSE coalesce(ninside, nxt) END AS sink, CAST(100 AS DOUBLE) AS percent"
# Few cells drain to one link here, so half of a lake's cells is the share.
query(
    "gs_24",
    f"WITH RECURSIVE {_LAKES} SELECT 'CH' AS source_cat, reach AS source, {_SINK} FROM fin WHERE inside IS NULL UNION ALL SELECT 'RES', lake, {_SINK} FROM outs",
)(lambda t: lakes.add_lakes(network_with_areas(t), lake_table(t), 0.5)[1])
query("gs_24_reaches", f"WITH RECURSIVE {_LAKES} SELECT reach, link, lake, inside, CAST(cells AS BIGINT) AS cells, last, CAST(area AS BIGINT) AS area, round(z, 4) AS z FROM fin")(
    lambda t: lakes.add_lakes(network_with_areas(t), lake_table(t), 0.5)[0].select("reach", "link", "lake", "inside", "cells", "last", "area", F.round("z", 4).alias("z"))
)
query(
    "gs_24_lakes",
    f"""WITH RECURSIVE {_LAKES},
    a AS (SELECT lake, min(playa) AS playa, count(DISTINCT node) AS n FROM lt GROUP BY 1),
    i AS (SELECT ninside AS lake, count(*) AS inlets, avg(z) AS high FROM fin WHERE inside IS NULL AND ninside IS NOT NULL GROUP BY 1),
    p AS (SELECT inside AS lake, count(*) AS within FROM fin WHERE inside IS NOT NULL GROUP BY 1),
    o AS (SELECT fin.lake, count(*) AS others FROM fin JOIN outs ON outs.lake = fin.lake WHERE fin.ninside IS DISTINCT FROM fin.lake AND fin.last <> outs.last GROUP BY 1)
    SELECT lake, playa, CAST(CASE WHEN playa THEN n ELSE coalesce(size, 0) END AS BIGINT) AS cells, CAST(coalesce(inlets, 0) AS BIGINT) AS inlets, CAST(coalesce(within, 0) AS BIGINT) AS within, outs.last AS outlet, nxt AS next,
      CAST(coalesce(others, 0) AS BIGINT) AS others, round(coalesce(high, z), 4) AS z
    FROM a LEFT JOIN size USING (lake) LEFT JOIN i USING (lake) LEFT JOIN p USING (lake) LEFT JOIN outs USING (lake) LEFT JOIN o USING (lake)""",
)(lambda t: lakes.add_lakes(network_with_areas(t), lake_table(t), 0.5)[2].withColumn("z", F.round("z", 4)))


def channel_basins(t):
    """node, basin: for every cell the link of the first stream cell on its way down."""
    cells = drained(t)
    wet = terrain.stream_cells(cells, 3)
    moved = terrain.move_to_streams(cells.select(c("node").alias("point"), "node"), cells, wet)
    return moved.join(wet.select(c("node").alias("moved"), c("link").alias("basin")), "moved", "left").select("node", "basin")


query(
    "gs_24_basins",
    f"""WITH RECURSIVE {_LAKES}, b AS (SELECT walk.node, min_by(m.link, areas.area) AS basin FROM walk JOIN m ON m.node = walk.pos JOIN areas ON areas.node = m.node GROUP BY 1)
    SELECT basin, CAST(count(*) AS BIGINT) AS cells, CAST(count(lake) AS BIGINT) AS in_lakes FROM e LEFT JOIN b USING (node) LEFT JOIN lk USING (node) GROUP BY 1""",
)(lambda t: lakes.lake_basins(channel_basins(t), lake_table(t)))
query(
    "gs_24_outlets",
    f"""WITH RECURSIVE {_DRAINED},
    lk AS MATERIALIZED (SELECT (s_suppkey * 3 // 2 + r) * 2147483648 + s_suppkey * 7 % 21 + q AS node, max(s_suppkey) AS lake FROM supplier, range(3) a(r), range(4) b(q) WHERE s_nationkey % 5 <> 0 GROUP BY 1),
    o AS (SELECT c_custkey AS point, c_custkey % 150 * 2147483648 + c_nationkey % 24 AS node FROM customer),
    t(point, pos, steps, lake) AS (SELECT point, node, 0, lake FROM o JOIN lk USING (node)
      UNION ALL SELECT point, e.down, steps + 1, t.lake FROM t JOIN e ON e.node = t.pos JOIN lk ON lk.node = e.down WHERE lk.lake = t.lake)
    SELECT o.point, o.node, lk.lake, CASE WHEN steps <= 2 THEN pos ELSE o.node END AS moved, CASE WHEN lk.lake IS NOT NULL THEN steps <= 2 END AS found
    FROM o LEFT JOIN lk USING (node) LEFT JOIN (SELECT point, max_by(pos, steps) AS pos, max(steps) AS steps FROM t GROUP BY 1) w USING (point)""",
)(lambda t: lakes.to_perimeter(outlets(t), drained(t), lake_table(t), 2))
