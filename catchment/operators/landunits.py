"""Land units: cells gathered by unit, crop, soil and slope; dominance, thresholds, redistribution.

Tables of units have the columns unit, crop, soil, slope, area. Ties of dominance go to the smallest
key. Every filter keeps each unit's area: what stays is scaled by total over kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut

KEYS = ["crop", "soil", "slope"]


def accumulate(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of each group: count, area, sums and ranges of elevation, and the farthest cell."""
    return cells.groupBy(*by).agg(
        F.count("*").alias("cells"),
        F.sum("area").alias("area"),
        F.sum(F.col("elevation") * F.col("area")).alias("elevation_area"),
        F.min("elevation").alias("lowest"),
        F.max("elevation").alias("highest"),
        F.max_by("cell", F.struct("distance", -F.col("cell"))).alias("farthest"),
    )


def areas(units: DataFrame, by: str) -> DataFrame:
    """Areas by unit and key, with unit totals and the grand total (nulls stand for all)."""
    return units.rollup("unit", by).agg(F.sum("area").alias("area"))


def dominant_units(units: DataFrame) -> DataFrame:
    """Each unit's largest (crop, soil, slope) with the whole unit's area."""
    totals = units.groupBy("unit", *KEYS).agg(F.sum("area").alias("part"))
    w = Window.partitionBy("unit").orderBy(F.desc("part"), *KEYS)
    ranked = totals.withColumn("rank", F.row_number().over(w)).withColumn("area", F.sum("part").over(Window.partitionBy("unit")))
    return ranked.where("rank = 1 and part > 0").select("unit", *KEYS, "area")


def dominant_each(units: DataFrame) -> DataFrame:
    """Each unit's largest crop, soil and slope, found independently, with the whole area."""
    out = units.groupBy("unit").agg(F.sum("area").alias("area"))
    for key in KEYS:
        totals = units.groupBy("unit", key).agg(F.sum("area").alias("part")).where("part > 0")
        w = Window.partitionBy("unit").orderBy(F.desc("part"), key)
        best = totals.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("unit", key)
        out = out.join(best, "unit")
    return out


def _stage(units: DataFrame, by: list[str], key: str, limit: Column, exempt: Column) -> DataFrame:
    """Drops keys whose area inside ``by`` is under the limit, never all of them; the rest are scaled."""
    group, one = Window.partitionBy(*by), Window.partitionBy(*by, key)
    rows = units.withColumn("_key", F.sum("area").over(one)).withColumn("_all", F.sum("area").over(group)).withColumn("_exempt", exempt)
    rows = rows.withColumn("_top", F.max("_key").over(group)).withColumn("_has", F.max(F.col("_exempt").cast("int")).over(group) == 1)
    bound = F.when(F.col("_has"), limit).otherwise(F.least(limit, F.col("_top")))
    kept = rows.where(F.col("_exempt") | (F.col("_key") >= bound))
    factor = F.col("_all") / F.sum("area").over(group)
    return kept.withColumn("area", F.col("area") * factor).drop("_key", "_all", "_top", "_exempt", "_has")


def threshold(units: DataFrame, crop: float, soil: float, slope: float, percent: bool = True, exempt: list[str] | None = None) -> DataFrame:
    """Crops, then soils of each crop, then slopes of each soil under a limit go.

    Limits are percentages of the enclosing area as rescaled so far, or areas. Exempt crops never go;
    in a unit with one, the crop limit isn't lowered to the largest crop.
    """
    of = (lambda x: F.col("_all") * x / 100) if percent else F.lit
    spared = F.col("crop").isin(exempt) if exempt else F.lit(False)
    units = _stage(units, ["unit"], "crop", of(crop), spared)
    units = _stage(units, ["unit", "crop"], "soil", of(soil), F.lit(False))
    return _stage(units, ["unit", "crop", "soil"], "slope", of(slope), F.lit(False))


def remove_smallest(units: DataFrame, least: float, exempt: list[str] | None = None) -> DataFrame:
    """Drops the smallest part of a unit under ``least`` and rescales, again and again; one part stays.

    Rescaling keeps the order of the parts, and once the smallest are gone the rest has grown by the whole area over
    what is left of it. So one running sum over a unit's parts tells the first that is large enough by then: all before it go.
    Ties go by the keys. Exempt crops, and parts without an area, stay; a unit of area 0 isn't rescaled.
    """
    spared = F.col("area").isNull() | (F.coalesce(F.col("crop").isin(exempt), F.lit(False)) if exempt else F.lit(False))
    unit = Window.partitionBy("unit")
    order = Window.partitionBy("unit", "_spared").orderBy("area", *KEYS)
    rows = units.groupBy("unit", *KEYS).agg(F.sum("area").alias("area")).withColumn("_spared", spared)
    rows = rows.select("*", F.sum("area").over(unit).alias("_all"), F.count("*").over(unit).alias("_n"), F.row_number().over(order).alias("_rank"), F.sum("area").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_gone"))
    left = F.col("_all") - F.coalesce("_gone", F.lit(0))
    grown = F.col("area") * F.when(left > 0, F.col("_all") / left).otherwise(1.0)
    ended = F.max(grown >= least).over(order.rowsBetween(Window.unboundedPreceding, 0)) | (F.col("_rank") >= F.col("_n"))
    kept = rows.withColumn("_ended", ended).where("_spared or _ended")
    rest = F.sum("area").over(unit)
    return kept.withColumn("area", F.col("area") * F.when(rest > 0, F.col("_all") / rest).otherwise(1.0)).select("unit", *KEYS, "area")


def remove_to_target(units: DataFrame, target: int, exempt: list[str] | None = None) -> DataFrame:
    """Drops the smallest parts of all units until ``target`` are left (exempt crops stay); rescales.

    The cut is found by a sort-and-limit on the areas; no rank over the whole table is needed.
    """
    spared = F.col("crop").isin(exempt) if exempt else F.lit(False)
    units = cut(units)
    out = max(0, units.count() - target)
    smallest = units.where(~spared).orderBy("area", "unit", *KEYS).limit(out)
    kept = units.join(smallest.select("unit", *KEYS), ["unit", *KEYS], "left_anti")
    total = units.groupBy("unit").agg(F.sum("area").alias("total"))
    rest = kept.groupBy("unit").agg(F.sum("area").alias("rest"))
    return kept.join(total, "unit").join(rest, "unit").select("unit", *KEYS, (F.col("area") * F.col("total") / F.col("rest")).alias("area"))


def crop_limit(units: DataFrame, key: str = "crop", percent: bool = True) -> DataFrame:
    """The greatest limit that leaves every unit a key: the least over units of the largest share."""
    parts = units.groupBy("unit", key).agg(F.sum("area").alias("part"))
    whole = F.sum("part").over(Window.partitionBy("unit"))
    share = 100 * F.col("part") / whole if percent else F.col("part")
    return parts.select("unit", share.alias("share")).groupBy("unit").agg(F.max("share").alias("top")).agg(F.min("top").alias("limit"))


def redistribute(units: DataFrame, removed: Column) -> DataFrame:
    """Drops the parts that ``removed`` holds for and scales the rest of their unit."""
    w = Window.partitionBy("unit")
    rows = units.withColumn("_total", F.sum("area").over(w)).where(~removed)
    return rows.withColumn("area", F.col("area") * F.col("_total") / F.sum("area").over(w)).drop("_total")


def merge(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Units replaced by the target they merge into; areas add up. ``targets``: unit, target."""
    moved = units.join(targets, "unit", "left").withColumn("unit", F.coalesce("target", "unit")).drop("target")
    return moved.groupBy("unit", *KEYS).agg(F.sum("area").alias("area"))


def split(units: DataFrame, shares: DataFrame) -> DataFrame:
    """Crops split into sub-crops by percent. ``shares``: crop, sub, percent; other crops stay."""
    joined = units.join(shares, "crop", "left")
    return joined.select("unit", F.coalesce("sub", "crop").alias("crop"), "soil", "slope", (F.col("area") * F.coalesce(F.col("percent") / 100, F.lit(1.0))).alias("area"))


def runs(ids: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Ordinals of each key with runs of neighbours as ``first, -last``, joined by commas."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    rows = ids.select(*by, ordinal).distinct().withColumn("island", F.col(ordinal) - F.row_number().over(w))
    spans = rows.groupBy(*by, "island").agg(F.min(ordinal).alias("a"), F.max(ordinal).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit(",-"), F.col("b").cast("string")))
    lists = spans.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("a", text.alias("text")))).alias("l"))
    return lists.select(*by, F.array_join(F.transform("l", lambda x: x["text"]), ",").alias("elements"))


# Rasters as cell tables (row, col, value)


def map_one(cells: DataFrame, f, nodata: float | None = None) -> DataFrame:
    """Applies ``f`` to values; nodata becomes null."""
    value = F.when(~F.col("value").eqNullSafe(F.lit(nodata)), F.col("value"))
    return cells.select("row", "col", f(value).alias("value"))


def map_two(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """Applies ``f`` to the values of two rasters cell by cell; cells of either alone are null there."""
    left, right = a.withColumnRenamed("value", "_a"), b.withColumnRenamed("value", "_b")
    return left.join(right, ["row", "col"], "full").select("row", "col", f(F.col("_a"), F.col("_b")).alias("value"))


#: Eight directions, counter-clockwise from east: (row step, column step).
DIRECTIONS = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def downstream_cell(cells: DataFrame) -> DataFrame:
    """row, col, down_row, down_col from a raster of directions 1..8."""
    step = lambda k: F.element_at(F.array(*[F.lit(d[k]) for d in DIRECTIONS]), F.col("value").cast("int"))
    return cells.where("value between 1 and 8").select("row", "col", (F.col("row") + step(0)).alias("down_row"), (F.col("col") + step(1)).alias("down_col"))


def steepest(cells: DataFrame) -> DataFrame:
    """row, col, value (direction 1..8 of the steepest descent) where a neighbour is lower; ties go to the first."""
    around = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (r, c) in enumerate(DIRECTIONS, 1)]))
    out = cells.select("row", "col", "value", around.alias("d"))
    out = out.select("row", "col", F.col("value").alias("z"), F.col("d.k").alias("k"), (F.col("row") + F.col("d.r")).alias("nr"), (F.col("col") + F.col("d.c")).alias("nc"))
    near = cells.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("value").alias("nz"))
    length = F.when(F.col("k") % 2 == 1, 1.0).otherwise(2**0.5)
    drops = out.join(near, ["nr", "nc"]).withColumn("drop", (F.col("z") - F.col("nz")) / length).where("drop > 0")
    return drops.groupBy("row", "col").agg(F.max_by("k", F.struct("drop", -F.col("k"))).alias("value"))


def slope_position(depth: DataFrame, height: DataFrame, limit: float) -> DataFrame:
    """1 for floodplain cells: valley depth over depth plus ridge height at most ``limit``."""

    def f(d, h):
        whole = d + h
        return F.when(F.when(whole.cast("int") == 0, 0.0).otherwise(F.try_divide(d, whole)) <= limit, 1).otherwise(0)

    return map_two(depth, height, f)


def grid_cells(cells: DataFrame, size: int) -> DataFrame:
    """Coarse cells: rows and columns divided by size, cells with flow, and the cell of greatest flow."""
    return cells.groupBy(F.expr(f"row div {size}").alias("grid_row"), F.expr(f"col div {size}").alias("grid_col")).agg(
        F.count_if(F.col("value") > 0).alias("count"), F.max_by(F.struct("row", "col"), F.struct(F.col("value"), -F.col("row"), -F.col("col"))).alias("drain")
    )




def zonal(rasters: dict[str, DataFrame], zones: list[str], value: str) -> DataFrame:
    """zones, cells, the sum of ``value``, lowest and highest over the cells that all rasters have.

    Each raster has row, col and a column of its name; they meet cell by cell in equi-joins.
    """
    joined = rasters[value]
    for zone in zones:
        joined = joined.join(rasters[zone], ["row", "col"])
    return joined.groupBy(*zones).agg(F.count("*").alias("cells"), F.sum(value).alias(f"{value}_sum"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
