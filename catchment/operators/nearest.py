"""Nearest stations and points by a grid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.operators.iterate import cut

#: Distinct places of stations up to which their table is broadcast and each point meets all of them.
SMALL = 256
#: Stations that the fullest cell of the finest grid has at most, and halvings of the cells at most.
FULL, HALVINGS = 64, 24


def distance2(x: Column, y: Column, sx: Column, sy: Column, weighted: bool) -> Column:
    """Squared distance in degrees; weighted: the east-west part by cos(latitude) squared (y is the latitude)."""
    east = F.pow(x - sx, 2) * (F.pow(F.cos(F.radians(y)), 2) if weighted else 1)
    return east + F.pow(y - sy, 2)


def _placed(table: DataFrame, x: str, y: str) -> DataFrame:
    """``table`` without the rows whose place is null, not a number or infinite."""
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in (x, y)]
    return table.where(known[0] & known[1])


def nearest(points: DataFrame, stations: DataFrame, weighted: bool = False, limit: float | None = None, small: int = SMALL) -> DataFrame:
    """id, station, d2: each point's nearest station; ties go to the smallest station.

    points: id, x, y; stations: station, sx, sy. Rows without a finite place are left out, as are
    points without a station within ``limit``; without stations there is no row. Stations at one
    place count as the smallest of them. A table of at most ``small`` places (counted) is broadcast.
    In a larger one each point meets the stations of its cell and the eight around it; where none is
    surely the nearest, the cells double in size for the next round.
    """
    points = _placed(points, "x", "y")
    stations = cut(_placed(stations.where("station is not null"), "sx", "sy").groupBy("sx", "sy").agg(F.min("station").alias("station")))
    if stations.count() <= small:
        found = _best(points.crossJoin(F.broadcast(stations.agg(F.collect_list(F.struct("sx", "sy", "station")).alias("near")))), weighted)
    else:
        found = _by_cells(points, stations, weighted)
    return found.where(F.col("d2") <= limit * limit) if limit is not None else found


def nearest_of_list(points: DataFrame, listed: DataFrame, by: str) -> DataFrame:
    """id, station, d2: the nearest of each point's own list (column ``by`` of both tables); ties go to the smallest station.

    A list is sought by cells, as all stations are in ``nearest``; rows without a finite place are left out.
    """
    stations = _placed(listed.where("station is not null"), "sx", "sy").groupBy(by, "sx", "sy").agg(F.min("station").alias("station"))
    return _by_cells(_placed(points, "x", "y"), cut(stations), False, (by,))


def _best(met: DataFrame, weighted: bool, *more: str) -> DataFrame:
    """id, station, d2 and the least of each of ``more``: the nearest of the stations in the arrays ``near``, an array at a time."""
    far = F.transform("near", lambda s: F.struct(distance2(F.col("x"), F.col("y"), s["sx"], s["sy"], weighted).alias("d2"), s["station"].alias("station")))
    rows = met.select("id", F.array_min(far).alias("best"), *more).where("best is not null")
    return rows.groupBy("id").agg(F.min("best").alias("best"), *[F.min(x).alias(x) for x in more]).select("id", "best.station", "best.d2", *more)


def _by_cells(points: DataFrame, stations: DataFrame, weighted: bool, by: tuple[str, ...] = ()) -> DataFrame:
    box = stations.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1")).first()
    width = max(float(box["x1"] or 0) - float(box["x0"] or 0), float(box["y1"] or 0) - float(box["y0"] or 0), 1e-9)
    cell = lambda c, low, size: F.floor((F.col(c) - F.lit(float(low or 0))) / size).cast("long")

    def fullest(size):
        cells = stations.groupBy(*by, cell("sx", box["x0"], size).alias("cx"), cell("sy", box["y0"], size).alias("cy")).count()
        return cells.agg(F.max("count")).first()[0] or 0

    level = 0
    while (most := fullest(width / 2**level)) > FULL and level < HALVINGS:
        level += 1
    # Points outside the stations' box are sought from its edge: no station is nearer than that way.
    edge = lambda c, a, b: F.least(F.greatest(F.col(c), F.lit(float(a or 0))), F.lit(float(b or 0)))
    todo = points.select("id", *by, "x", "y", edge("x", box["x0"], box["x1"]).alias("qx"), edge("y", box["y0"], box["y1"]).alias("qy"))
    todo = cut(todo.withColumn("off", distance2(F.col("x"), F.col("y"), F.col("qx"), F.col("qy"), weighted)))
    scale = F.least(F.lit(1.0), F.pow(F.cos(F.radians("y")), 2)) if weighted else F.lit(1.0)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    done = None
    while True:
        size = width / 2**level
        rows = todo.withColumn("cx", cell("qx", box["x0"], size)).withColumn("cy", cell("qy", box["y0"], size))
        own = stations.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        own = own.select(*by, "sx", "sy", "station", (cell("sx", box["x0"], size) + F.col("dx")).alias("cx"), (cell("sy", box["y0"], size) + F.col("dy")).alias("cy"))
        # A point meets arrays of the stations around, of FULL on average or all of a few; a crowded cell has several.
        own = own.withColumn("tile", F.pmod(F.xxhash64("sx", "sy"), F.lit(-(-most // FULL))))
        own = own.groupBy(*by, "cx", "cy", "tile").agg(F.collect_list(F.struct("sx", "sy", "station")).alias("near")).drop("tile")
        met = rows.join(own, [*by, "cx", "cy"]).withColumn("sure", F.col("off") + scale * size * size)
        # All that isn't met lies over a cell away from where the search began.
        found = _best(met, weighted, "sure")
        found = cut((found if level == 0 else found.where("d2 < sure")).select("id", "station", "d2"))
        done = found if done is None else done.unionByName(found)
        if level == 0:
            return done
        todo = cut(todo.join(found, "id", "left_anti"))
        if todo.isEmpty():
            return done
        level -= 1
        most = fullest(width / 2**level)
