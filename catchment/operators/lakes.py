"""Lakes on streams, as tables of cells: stream links are cut where they enter and leave lakes, and routed through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.operators.iterate import cut
from catchment.operators.network import descend


def lake_cells(lakes: DataFrame) -> DataFrame:
    """node, lake: each cell of a lake that takes part in routing; a cell of several counts for the greatest.

    ``lakes``: node, lake, playa. Playas (true) hold water that no stream enters, so they cut no link. Null cells and lakes are left out.
    """
    routed = lakes.where("node is not null and lake is not null and not coalesce(playa, false)")
    return routed.groupBy("node").agg(F.max("lake").alias("lake"))


def cut_reaches(streams: DataFrame, lakes: DataFrame) -> DataFrame:
    """reach, link, lake, cells, last, area, z, next, next_lake: links cut where they enter or leave a lake, each with the one that follows.

    ``streams``: node, down, link, place, z, area, a row a cell (area: the cells that drain through it). A reach is named after its
    first cell; ``lake`` is null outside lakes; area and z are those of its last cell; ``next`` is null at an outlet. The cells of a reach
    are followed up to its first by pointer doubling, so that no link lies in one task.
    """
    wet = cut(streams.select("node", "down", "link", "place", "z", "area").join(lake_cells(lakes), "node", "left"))
    above = wet.where("down is not null").select(F.col("down").alias("node"), F.col("node").alias("up"), F.col("link").alias("_link"), F.col("lake").alias("_lake"))
    same = wet.join(above, "node").where((F.col("link") == F.col("_link")) & F.col("lake").eqNullSafe(F.col("_lake")))
    firsts = descend(same.select("node", F.col("up").alias("down"))).select("node", F.col("target").alias("reach"))
    cells = cut(wet.join(firsts, "node", "left").withColumn("reach", F.coalesce("reach", "node")))
    end = F.max_by(F.struct("node", "down", "area", "z"), "place").alias("e")
    reaches = cells.groupBy("reach").agg(F.min("link").alias("link"), F.min("lake").alias("lake"), F.count("*").alias("cells"), end)
    onward = cells.select(F.col("node").alias("down"), F.col("reach").alias("next"), F.col("lake").alias("next_lake"))
    reaches = reaches.select("reach", "link", "lake", "cells", F.col("e.node").alias("last"), "e.down", "e.area", "e.z")
    return reaches.join(onward, "down", "left").select("reach", "link", "lake", "cells", "last", "area", "z", "next", "next_lake")


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def add_lakes(streams: DataFrame, lakes: DataFrame, share: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stream network with its lakes: (reaches, routing, lakes). ``streams`` and ``lakes`` as in ``cut_reaches``.

    A lake's outlet is where the stream with the greatest area leaves it or ends in it (ties: the smaller cell); all that enters the
    lake leaves there, and the reaches below its other exits begin dry. The reach below the outlet belongs to the lake if it
    is the outlet of no other, fewer cells than ``share`` of the lake's drain to it alone, and a reach outside lakes follows; the outlet then is below it.

    Reaches: as from ``cut_reaches``, with ``inside``, the lake whose part a reach is (null: it is a channel).
    Routing: source_cat (CH, RES), source, sink_cat (CH, RES, X), sink, percent: one row for each channel and lake with an outlet. X is an outlet of the network, its sink a cell.
    The area at the outlets grows along every way, so routing has no loops, though streams may enter a lake again.
    Lakes: lake, playa, cells, inlets, within (reaches), outlet (its last cell), next, others (exits), z: the inlets' mean, or the outlet's. A lake that
    meets no stream has no outlet and no routing; one with rows of both kinds is a lake.
    """
    reaches = cut(cut_reaches(streams, lakes))
    exits = reaches.where(F.col("lake").isNotNull() & _differ(F.col("lake"), F.col("next_lake")))
    first = F.struct(F.col("area").alias("a"), (-F.col("last")).alias("b"))
    main = exits.groupBy("lake").agg(F.max_by(F.struct("last", "next", "next_lake", "z"), first).alias("m")).select("lake", "m.*")
    sizes = lake_cells(lakes).groupBy("lake").agg(F.count("*").alias("size"))
    main = cut(main.join(sizes, "lake"))

    inflow = reaches.where("next is not null").groupBy(F.col("next").alias("reach")).agg(F.sum("area").alias("inflow"))
    below = main.where("next is not null and next_lake is null").groupBy(F.col("next").alias("reach")).agg(F.min("lake").alias("taker"), F.max("size").alias("size"), F.count("*").alias("n"))
    small = below.where("n = 1").join(reaches.where("next is not null and next_lake is null").select("reach", "area", F.col("next").alias("onward")), "reach").join(inflow, "reach", "left")
    taken = cut(small.where(F.col("area") - F.coalesce("inflow", F.lit(0)) < F.lit(share) * F.col("size")).select("reach", "taker", "onward"))

    inside = reaches.join(taken.select("reach", "taker"), "reach", "left").withColumn("inside", F.coalesce("lake", "taker")).drop("taker")
    then = inside.select(F.col("reach").alias("next"), F.col("inside").alias("_in"))
    final = cut(inside.drop("next_lake").join(then, "next", "left").withColumnRenamed("_in", "next_inside"))
    kind = F.when(F.col("next").isNull(), "X").when(F.col("next_inside").isNotNull(), "RES").otherwise("CH")
    sink = F.when(F.col("next").isNull(), F.col("last")).otherwise(F.coalesce(F.col("next_inside").cast("long"), "next"))
    outlets = main.join(taken.select(F.col("reach").alias("next"), "onward"), "next", "left").select("lake", "last", "z", F.coalesce("onward", "next").alias("next"))
    outlets = cut(outlets.join(then, "next", "left").withColumnRenamed("_in", "next_inside"))
    percent = F.lit(100.0).alias("percent")
    routing = final.where("inside is null").select(F.lit("CH").alias("source_cat"), F.col("reach").alias("source"), kind.alias("sink_cat"), sink.alias("sink"), percent)
    routing = routing.unionByName(outlets.select(F.lit("RES").alias("source_cat"), F.col("lake").cast("long").alias("source"), kind.alias("sink_cat"), sink.alias("sink"), percent))

    into = final.where("inside is null and next_inside is not null").groupBy(F.col("next_inside").alias("lake")).agg(F.count("*").alias("inlets"), F.avg("z").alias("high"))
    part = final.where("inside is not null").groupBy(F.col("inside").alias("lake")).agg(F.count("*").alias("within"))
    leave = final.where(F.col("lake").isNotNull() & _differ(F.col("lake"), F.col("next_inside")))
    others = leave.join(outlets.select("lake", F.col("last").alias("_main")), "lake").where("last <> _main").groupBy("lake").agg(F.count("*").alias("others"))
    dry = lakes.where("node is not null and lake is not null").groupBy("lake").agg(F.min(F.coalesce("playa", F.lit(False))).alias("playa"), F.count_distinct("node").alias("all"))
    rows = dry.join(sizes, "lake", "left").join(into, "lake", "left").join(part, "lake", "left").join(outlets, "lake", "left").join(others, "lake", "left")
    none = F.lit(0).cast("long")
    return (
        final,
        routing,
        rows.select(
            "lake", "playa", F.when(F.col("playa"), F.col("all")).otherwise(F.coalesce("size", none)).alias("cells"), F.coalesce("inlets", none).alias("inlets"),
            F.coalesce("within", none).alias("within"), F.col("last").alias("outlet"), "next", F.coalesce("others", none).alias("others"), F.coalesce("high", "z").alias("z"),
        ),
    )


def lake_basins(basins: DataFrame, lakes: DataFrame) -> DataFrame:
    """basin, cells, in_lakes: cells of each channel basin (``basins``: node, basin) and those of them that lakes take out of it.

    Cells without a basin make the row of a null basin. Playas take nothing.
    """
    marked = basins.join(lake_cells(lakes), "node", "left")
    return marked.groupBy("basin").agg(F.count("*").alias("cells"), F.count("lake").alias("in_lakes"))


def to_perimeter(points: DataFrame, cells: DataFrame, lakes: DataFrame, most: int) -> DataFrame:
    """point, node, lake, moved, found: points inside lakes moved down to the last cell of the lake; beyond ``most`` steps they stay (found: false).

    ``points``: point, node. ``cells``: node, down. Points outside lakes stay, their lake and ``found`` null.
    """
    wet = cut(lake_cells(lakes))
    own = cells.select("node", "down").join(wet, "node").join(wet.select(F.col("node").alias("down"), F.col("lake").alias("_lake")), "down").where("lake = _lake")
    ends = descend(own.select("node", "down")).select("node", "target", "steps")
    at = points.select("point", "node").join(wet, "node", "left").join(ends, "node", "left")
    near = F.col("target").isNotNull() & (F.col("steps") <= most)
    # A cell whose way stays inside has a row of steps; one without is the last of its lake itself, unless its way ends in a loop.
    looped = own.select("node", F.lit(True).alias("_goes")).distinct()
    at = at.join(looped, "node", "left")
    found = F.when(F.col("lake").isNotNull(), F.coalesce(near, F.lit(False)) | F.col("_goes").isNull())
    return at.select("point", "node", "lake", F.when(F.coalesce(near, F.lit(False)), F.col("target")).otherwise(F.col("node")).alias("moved"), found.alias("found"))
