"""Terrain on tables of cells (row, col, ...): regions and their outlines, filled pits, stream links.

A cell's key is a struct of row and col; a cell that has no row in the table, or a null value, is
nodata. Components, outlines and basins are found by joins whose rounds are logarithms of the size:
chains are followed by pointer doubling and graphs are contracted. No raster, tile or ring is ever in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut
from catchment.operators.landunits import DIRECTIONS
from catchment.operators.network import descend, strahler, upstream

#: Bits of a packed cell key that hold the column.
COL_BITS = 31


def cell_key(row: Column, col: Column) -> Column:
    """One long for a cell; keys are ordered by row, then column. Rows lie within 29 bits, columns between 0 and 2**31."""
    return F.shiftleft(row.cast("long"), COL_BITS) + col.cast("long")


def key_row(key: Column) -> Column:
    return F.shiftright(key, COL_BITS)


def key_col(key: Column) -> Column:
    return key.bitwiseAND((1 << COL_BITS) - 1)


def _roots(hooks: DataFrame) -> DataFrame:
    """node, root: where the chains of ``hooks`` (node, up) end; hooks have no rings."""
    return descend(hooks.select("node", F.col("up").alias("down"))).select("node", F.col("target").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour below it, follows the hooks to their ends and
    joins the ends' edges. Loops, repeats and both directions are fine; edges with a null end are none.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        found = cut(_roots(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))))
        for end in ("a", "b"):
            left = left.join(found.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
        left = left.select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y")).where("x <> y")
        left = cut(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            labels = found
        else:
            onward = found.select(F.col("node").alias("root"), F.col("root").alias("_root"))
            labels = cut(labels.join(onward, "root", "left").select("node", F.coalesce("_root", "root").alias("root")).unionByName(found))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    ends = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.unionByName(ends)


def regions(cells: DataFrame) -> DataFrame:
    """row, col, value, region: 4-connected cells of equal value; region is the key of its first cell.

    Cells of a row that touch and are equal make runs first, so that the graph has runs for nodes.
    Cells without a value belong to no region; a cell that is given twice counts once, with its smallest value.
    """
    known = cells.where("value is not null").groupBy("row", "col").agg(F.min("value").alias("value"))
    line = Window.partitionBy("row").orderBy("col")
    breaks = (F.col("col") - F.lag("col").over(line) == 1) & (F.col("value") == F.lag("value").over(line))
    runs = known.withColumn("_first", F.when(~F.coalesce(breaks, F.lit(False)), F.col("col")))
    runs = cut(runs.withColumn("run", cell_key(F.col("row"), F.last("_first", ignorenulls=True).over(line))).select("row", "col", "value", "run"))
    above = runs.select((F.col("row") + 1).alias("row"), "col", "value", F.col("run").alias("_run"))
    roots = components(runs.join(above, ["row", "col", "value"]).select(F.col("run").alias("a"), F.col("_run").alias("b")))
    return runs.join(roots.withColumnRenamed("node", "run"), "run", "left").select("row", "col", "value", F.coalesce("root", "run").alias("region"))


#: Sides of a cell, clockwise with the cell on the right hand: (row, col) steps to the neighbour, from the cell to the side's start, to its end.
SIDES = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))]


def _of_side(place: str, part: int) -> Column:
    """A step of the side of direction ``d``: 0 to the neighbour, 1 to the side's start, 2 to its end."""
    return F.element_at(F.array(*[F.lit(side[part]["row col".split().index(place)]) for side in SIDES]), F.col("d") + 1)


def sides(labelled: DataFrame) -> DataFrame:
    """region, node, row, col, next_row, next_col: the sides of cells (row, col, region) that border on another region or none, each with its ends, in no order.

    ``node`` is the cell's key times 4 and the side's direction; the cell lies on the right hand.
    """
    every = labelled.select("region", "row", "col", F.explode(F.array(*[F.lit(d) for d in range(4)])).alias("d"))
    every = every.withColumn("_row", F.col("row") + _of_side("row", 0)).withColumn("_col", F.col("col") + _of_side("col", 0))
    near = labelled.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("region").alias("_region"))
    border = every.join(near, ["_row", "_col"], "left").where("_region is null or _region <> region")
    ends = [(F.col(place) + _of_side(place, part)).alias(name + place) for part, name in ((1, ""), (2, "next_")) for place in ("row", "col")]
    return border.select("region", (cell_key(F.col("row"), F.col("col")) * 4 + F.col("d")).alias("node"), *ends)


def outlines(labelled: DataFrame) -> DataFrame:
    """region, ring, place, row, col, next_row, next_col, turn, hole: the lattice points along every ring of every region, in order, each with the one that follows.

    ``labelled``: row, col, region. A ring begins at its smallest side; ``turn`` is false for points in a
    straight line, which a polygon doesn't need. The outer ring runs clockwise (rows go down), holes against it. Where two
    cells of a region touch only by a corner, the ring keeps to the same cell, so outer rings never
    touch themselves; holes that touch by a corner are one ring.
    """
    links = cut(sides(labelled))
    way = lambda node: node.bitwiseAND(3)
    ends = links.select("region", cell_key(F.col("next_row"), F.col("next_col")).alias("point"), "node")
    starts = links.select("region", cell_key(F.col("row"), F.col("col")).alias("point"), F.col("node").alias("down"))
    # Right turn (the same cell) before straight on before left turn.
    bend = F.pmod(way(F.col("down")) - way(F.col("node")) + 3, F.lit(4))
    onward = ends.join(starts, ["region", "point"]).select("node", "down", F.when(bend == 0, 1).when(bend == 3, 2).when(bend == 2, 3).alias("rank"))
    nexts = cut(onward.where("rank is not null").groupBy("node").agg(F.min_by("down", "rank").alias("down")))
    # Minima over the 1, 2, 4, ... sides that follow, the side itself not counted, with the steps to the first of them. The smallest side of a ring meets
    # itself once the spans are as long as the ring; all its sides then know it, and are set aside, so that rounds hold the longer rings only.
    state = nexts.select("node", F.col("down").alias("jump"), F.col("down").alias("low"), F.lit(1).cast("long").alias("left"))
    span, closed = 1, []
    while not state.isEmpty():
        done = state.where("low = node").select(F.col("node").alias("low"), F.col("left").alias("size"))
        if span < 4 or done.isEmpty():
            open_sides = state
        else:
            marked = cut(state.join(done, "low", "left"))
            closed.append(marked.where("size is not null").select("node", F.col("low").alias("ring"), "size", "left"))
            open_sides = marked.where("size is null").select("node", "jump", "low", "left")
        ahead = open_sides.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"), F.col("left").alias("_left"))
        nearer = F.col("low") <= F.col("_low")
        state = cut(open_sides.join(ahead, "jump").select("node", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"), F.when(nearer, F.col("left")).otherwise(F.col("_left") + span).alias("left")))
        span *= 2
    none = nexts.select("node", F.col("node").alias("ring"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("left")).limit(0)
    rings = reduce(DataFrame.unionByName, closed) if closed else none
    # A point turns where the side that leads to it and the one that leaves it differ.
    bends = nexts.select(F.col("down").alias("node"), (way(F.col("node")) != way(F.col("down"))).alias("turn"))
    # The smallest side of an outer ring is the top of a cell; of a hole, the bottom of one above it.
    hole = (way(F.col("ring")) != 0).alias("hole")
    placed = links.join(rings, "node").join(bends, "node")
    return placed.select("region", "ring", (F.col("size") - F.col("left")).alias("place"), "row", "col", "next_row", "next_col", "turn", hole)


def polygons(points: DataFrame) -> DataFrame:
    """region, rings, holes, area, perimeter, corners from the points of ``outlines``; areas are sums of the rings' signed areas."""
    twice = F.sum(F.col("col") * F.col("next_row") - F.col("next_col") * F.col("row"))
    rings = points.groupBy("region", "ring", "hole").agg((twice / 2).alias("area"), F.count("*").alias("length"), F.count_if("turn").alias("corners"))
    return rings.groupBy("region").agg(
        F.count("*").alias("rings"), F.count_if("hole").alias("holes"), F.sum("area").cast("long").alias("area"), F.sum("length").alias("perimeter"), F.sum("corners").alias("corners")
    )


def _around(cells: DataFrame, values: list[str]) -> DataFrame:
    """Each cell with each of its eight neighbours that exist: row, col, ``values``, ``_row``, ``_col``, and the neighbours' values as ``_name``."""
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in DIRECTIONS]))
    out = cells.select("row", "col", *values, step.alias("d")).select("row", "col", *values, (F.col("row") + F.col("d.r")).alias("_row"), (F.col("col") + F.col("d.c")).alias("_col"))
    near = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *[F.col(v).alias(f"_{v}") for v in values])
    return out.join(near, ["_row", "_col"])


def fill_pits(cells: DataFrame) -> DataFrame:
    """row, col, value, filled: each height raised to the least greatest height on any way out of the raster.

    A way out ends at a cell with fewer than eight neighbours; ways go to all eight. Every cell first runs down to the
    lowest neighbour below it (of equal heights the smaller key), so that pits own basins. Basins and
    the outside are a graph, a way over costing the greater height at the border. In every round each basin
    takes its cheapest way over, which no water in it can avoid, and those that are joined are contracted. A
    basin's level is the greatest cost it has taken until it meets the outside. Cells without a value are outside.
    """
    key = cell_key(F.col("row"), F.col("col"))
    known = cut(cells.where("value is not null").groupBy("row", "col").agg(F.min("value").cast("double").alias("value")))
    near = cut(_around(known, ["value"]).select(key.alias("node"), "value", cell_key(F.col("_row"), F.col("_col")).alias("other"), F.col("_value").alias("z")))
    lowest = near.groupBy("node", "value").agg(F.min(F.struct("z", "other")).alias("low"), F.count("*").alias("around"))
    down = lowest.where(F.struct("low.z", "low.other") < F.struct(F.col("value").alias("z"), F.col("node").alias("other"))).select("node", F.col("low.other").alias("down"))
    basins = descend(down).select("node", F.col("target").alias("basin"))
    owned = cut(known.select(key.alias("node"), "row", "col", "value").join(basins, "node", "left").select("node", "row", "col", "value", F.coalesce("basin", "node").alias("basin")))
    outside = F.lit(-(1 << 62)).cast("long")
    inner = lowest.where("around = 8").select("node")
    rim = owned.join(inner, "node", "left_anti").select(F.col("basin").alias("a"), outside.alias("b"), F.col("value").alias("cost"))
    own = owned.select("node", F.col("basin").alias("a"))
    border = near.where("node < other").join(own, "node").join(owned.select(F.col("node").alias("other"), F.col("basin").alias("b")), "other")
    border = border.where("a <> b").select("a", "b", F.greatest("value", "z").alias("cost"))
    graph = cut(border.unionByName(rim).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cost").groupBy("a", "b").agg(F.min("cost").alias("cost")))
    levels = cut(owned.select("basin").distinct().select("basin", F.col("basin").alias("at"), F.lit(None).cast("double").alias("level")))
    while not graph.isEmpty():
        both = graph.select(F.col("a").alias("node"), F.col("b").alias("up"), "cost").unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("up"), "cost"))
        # One order of the edges for all, so that the only rings are two basins that take each other: the smaller then stays.
        order = F.struct("cost", F.least("node", "up"), F.greatest("node", "up"))
        taken = cut(both.where(F.col("node") != outside).groupBy("node").agg(F.min_by(F.struct("up", "cost"), order).alias("t")).select("node", "t.up", "t.cost"))
        back = taken.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        hooks = taken.join(back, "up", "left").where(~F.coalesce((F.col("_up") == F.col("node")) & (F.col("node") < F.col("up")), F.lit(False)))
        roots = cut(_roots(hooks.select("node", "up")))
        costs = taken.select(F.col("node").alias("at"), "cost").join(roots.select(F.col("node").alias("at"), "root"), "at", "left")
        levels = levels.join(costs, "at", "left").select("basin", F.coalesce("root", "at").alias("at"), F.greatest("level", "cost").alias("level"))
        levels = cut(levels)
        for end in ("a", "b"):
            graph = graph.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
        graph = graph.select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"), "cost").where("x <> y")
        graph = cut(graph.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("cost").alias("cost")))
    return owned.join(levels.select("basin", "level"), "basin").select("row", "col", "value", F.greatest("value", "level").alias("filled"))


def stream_cells(cells: DataFrame, threshold: int) -> DataFrame:
    """node, down, z, step, area, link, place: the stream cells of ``cells`` (node, down, z, step), in links as ``stream_links`` makes them; area is of all cells that drain through one."""
    edges = cells.select("node", "down")
    area = upstream(edges, cells.select("node", F.lit(1).cast("long").alias("area")), ["area"])
    streams = cut(cells.join(area.where(F.col("area") >= threshold).select("node", "area"), "node"))
    into = streams.select("node", "down").join(streams.select(F.col("node").alias("down")), "down", "left_semi")
    gets = into.groupBy(F.col("down").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("up")).where("n = 1").select("node", "up")
    # From each cell that continues a link up to the link's start.
    starts = descend(gets.select("node", F.col("up").alias("down"))).select("node", F.col("target").alias("link"), F.col("steps").alias("place"))
    return cut(streams.join(starts, "node", "left").select("node", "down", "z", "step", "area", F.coalesce("link", "node").alias("link"), F.coalesce("place", F.lit(0)).alias("place")))


def stream_links(cells: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The stream network of directions: (stream cells, links).

    ``cells``: node, down, z, step (the length of the way to ``down``). A cell is a stream where at least ``threshold`` cells drain
    through it, itself counted. A link begins at a head or a junction and holds the stream cells down to the next one.
    Stream cells: node, link, place (from 0). Links: link, last, down (the next link, null at an outlet), cells, length (to the next link's start),
    drop, strahler. Cells that drain into a loop have no area and are no streams; a missing z gives a null drop.
    Where only the cells are asked for, ``stream_cells`` spares the orders' rounds.
    """
    members = stream_cells(cells, threshold)
    ends = members.groupBy("link").agg(
        F.max_by("node", "place").alias("last"), F.max_by("down", "place").alias("_down"), F.count("*").alias("cells"), F.min_by("z", "place").alias("_top"), F.max_by("z", "place").alias("_bottom"),
        F.sum(F.when(F.col("down").isNotNull(), F.col("step"))).alias("length"),
    )
    next_ = members.select(F.col("node").alias("_down"), F.col("link").alias("down"))
    links = cut(ends.join(next_, "_down", "left").select("link", "last", "down", "cells", F.coalesce("length", F.lit(0.0)).alias("length"), (F.col("_top") - F.col("_bottom")).alias("drop")))
    orders = strahler(links.select(F.col("link").alias("node"), "down")).select(F.col("node").alias("link"), "strahler")
    return members.select("node", "link", "place"), links.join(orders, "link")


def move_to_streams(points: DataFrame, cells: DataFrame, streams: DataFrame) -> DataFrame:
    """point, node, moved, steps: each point's cell, and the first stream cell on the way down from it (null: none).

    ``points``: point, node. ``cells``: node, down. ``streams``: node. Points on streams stay, those outside the cells or above no stream get null.
    """
    wet = streams.select("node").distinct()
    dry = cells.select("node", "down").join(wet, "node", "left_anti")
    ends = descend(dry).join(wet.select(F.col("node").alias("target")), "target", "left_semi").select("node", F.col("target").alias("moved"), "steps")
    reached = ends.unionByName(wet.select("node", F.col("node").alias("moved"), F.lit(0).alias("steps")))
    return points.select("point", "node").join(reached, "node", "left").select("point", "node", "moved", "steps")


def rasterise(sides: DataFrame) -> DataFrame:
    """row, col, value of every cell whose centre lies inside a polygon, by the even-odd rule over all its rings.

    ``sides``: polygon, value, x1, y1, x2, y2, in cells (the centre of row r and column c is c + 0.5, r + 0.5). A side gives a crossing with each
    row whose centre line it crosses, its lower end counted and its upper end not; ordered crossings open and
    close spans in turn, and a span holds the centres from its first crossing up to, not with, its last. Where
    polygons overlap the greatest ``polygon`` counts. Sides with a null end are left out.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")
    crossed = sides.where(F.col("x1").isNotNull() & F.col("x2").isNotNull() & (first <= last)).withColumn("row", F.explode(F.sequence(first, last)))
    x = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    line = Window.partitionBy("polygon", "row").orderBy("x")
    spans = crossed.select("polygon", "value", "row", x.alias("x")).select("polygon", "value", "row", "x", F.lead("x").over(line).alias("to"), (F.row_number().over(line) % 2).alias("opens")).where("opens = 1")
    start, end = F.ceil(F.col("x") - 0.5).cast("int"), (F.ceil(F.col("to") - 0.5) - 1).cast("int")
    cells = spans.where(start <= end).select("polygon", "value", "row", F.explode(F.sequence(start, end)).alias("col"))
    return cells.groupBy("row", "col").agg(F.max_by("value", "polygon").alias("value"))
