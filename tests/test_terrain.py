"""Regions and outlines, filled pits and stream links against brute force."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.operators import terrain

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def table(spark, grid, kind="double"):
    rows = [(int(r), int(c), None if v is None else float(v)) for (r, c), v in grid.items()]
    return spark.createDataFrame(rows, "row int, col int, value double").withColumn("value", F.col("value").cast(kind))


def flooded(grid):
    """Priority flood from the rim."""
    level = {}
    heap = [(z, k) for k, z in grid.items() if any((k[0] + a, k[1] + b) not in grid for a, b in EIGHT)]
    heapq.heapify(heap)
    while heap:
        z, k = heapq.heappop(heap)
        if k in level:
            continue
        level[k] = z
        for a, b in EIGHT:
            n = (k[0] + a, k[1] + b)
            if n in grid and n not in level:
                heapq.heappush(heap, (max(z, grid[n]), n))
    return level


def random_grid(seed, rows, cols, values, missing=0.05):
    r = np.random.default_rng(seed)
    return {(a, b): int(r.integers(0, values)) for a in range(rows) for b in range(cols) if r.random() > missing}


@pytest.mark.parametrize("seed, values", [(1, 1000), (2, 4)])
def test_filled_pits(spark, seed, values):
    grid = random_grid(seed, 25, 30, values, 0.02)
    rows = table(spark, grid | {(40, 40): None}).unionByName(table(spark, {(0, 0): grid.get((0, 0))}))
    got = {(r["row"], r["col"]): r["filled"] for r in terrain.fill_pits(rows).collect()}
    assert got == flooded(grid)


def test_no_cells(spark):
    none = table(spark, {(1, 1): None})
    assert terrain.fill_pits(none).count() == 0 and terrain.regions(none).count() == 0
    assert terrain.polygons(terrain.outlines(terrain.regions(none))).count() == 0


def brute_regions(grid):
    label = {}
    for k in sorted(grid):
        if k not in label:
            stack, label[k] = [k], k
            while stack:
                x = stack.pop()
                for a, b in FOUR:
                    n = (x[0] + a, x[1] + b)
                    if n in grid and n not in label and grid[n] == grid[x]:
                        label[n] = k
                        stack.append(n)
    return label


@pytest.mark.parametrize("seed, values", [(3, 2), (4, 3), (5, 1)])
def test_regions_and_outlines(spark, seed, values):
    grid = random_grid(seed, 14, 16, values)
    labelled = terrain.regions(table(spark, grid, "int"))
    want = brute_regions(grid)
    key = lambda k: (k[0] << terrain.COL_BITS) + k[1]
    assert {(r["row"], r["col"]): r["region"] for r in labelled.collect()} == {k: key(v) for k, v in want.items()}
    points = terrain.outlines(labelled.select("row", "col", "region")).collect()
    rings = {}
    for p in points:
        rings.setdefault((p["region"], p["ring"]), []).append(p)
    parts = {}
    for (region, _), ring in rings.items():
        ring.sort(key=lambda p: p["place"])
        assert [p["place"] for p in ring] == list(range(len(ring)))
        # Each point is followed by the next; the ring closes; every step is one long.
        assert all((p["next_row"], p["next_col"]) == (q["row"], q["col"]) for p, q in zip(ring, ring[1:] + ring[:1]))
        bends = [(q["row"] - p["row"], q["col"] - p["col"]) for p, q in zip(ring, ring[1:] + ring[:1])]
        assert all(abs(a) + abs(b) == 1 for a, b in bends)
        assert [p["turn"] for p in ring] == [a != b for a, b in zip(bends, bends[-1:] + bends[:-1])]
        parts.setdefault(region, []).append(ring)
    for region in {key(v) for v in want.values()}:
        inside = {k for k, v in want.items() if key(v) == region}
        outer = [ring for ring in parts[region] if not ring[0]["hole"]]
        assert len(outer) == 1
        # Even-odd rule at the cells' centres.
        for r in range(-1, 15):
            for c in range(-1, 17):
                crossed = sum(p["col"] == p["next_col"] and min(p["row"], p["next_row"]) == r and p["col"] > c for ring in parts[region] for p in ring)
                assert (crossed % 2 == 1) == ((r, c) in inside)
    found = {r["region"]: (r["area"], r["perimeter"], r["holes"]) for r in terrain.polygons(terrain.outlines(labelled.select("row", "col", "region"))).collect()}
    for region, (area, perimeter, holes) in found.items():
        inside = {k for k, v in want.items() if key(v) == region}
        pairs = sum((a, b + 1) in inside for a, b in inside) + sum((a + 1, b) in inside for a, b in inside)
        squares = sum({(a, b + 1), (a + 1, b), (a + 1, b + 1)} <= inside for a, b in inside)
        assert (area, perimeter, holes) == (len(inside), 4 * len(inside) - 2 * pairs, 1 - (len(inside) - pairs + squares))


def test_stream_links(spark):
    r = np.random.default_rng(9)
    down = {k: None if k == 0 else int(r.integers(max(0, k - 6), k)) for k in range(300)}
    down |= {400: 401, 401: 400, 402: 401}
    height, step = {k: float(r.integers(0, 100)) for k in down}, {k: float(r.integers(1, 9)) for k in down}
    rows = spark.createDataFrame([(k, d, height[k], step[k]) for k, d in down.items()], "node long, down long, z double, step double")
    members, links = terrain.stream_links(rows, 3)
    area = {k: 0 for k in down}
    for k in range(300):
        at = k
        while at is not None:
            area[at] += 1
            at = down[at]
    wet = {k for k, a in area.items() if a >= 3}
    ups = {k: [u for u in wet if down[u] == k] for k in wet}
    want, link_of = {}, {}
    for start in (k for k in wet if len(ups[k]) != 1):
        line = [start]
        while (d := down[line[-1]]) in wet and len(ups[d]) == 1:
            line.append(d)
        for place, k in enumerate(line):
            link_of[k] = (start, place)
        want[start] = line
    assert {x["node"]: (x["link"], x["place"]) for x in members.collect()} == link_of

    def order(link):
        above = sorted((order(link_of[u][0]) for u in ups[link]), reverse=True)
        return 1 if not above else above[0] + (len(above) > 1 and above[0] == above[1])

    for x in links.collect():
        line = want[x["link"]]
        after = down[line[-1]]
        assert (x["last"], x["cells"], x["drop"], x["strahler"]) == (line[-1], len(line), height[line[0]] - height[line[-1]], order(x["link"]))
        assert x["down"] == (link_of[after][0] if after is not None else None)
        assert x["length"] == sum(step[k] for k in line if down[k] is not None)
    assert links.count() == len(want)
    points = spark.createDataFrame([(1, 299), (2, 0), (3, 402), (4, 999), (5, None), (6, 299)], "point int, node long")
    moved = {x["point"]: (x["moved"], x["steps"]) for x in terrain.move_to_streams(points, rows, members).collect()}
    at, steps = 299, 0
    while at not in wet:
        at, steps = down[at], steps + 1
    assert moved == {1: (at, steps), 2: (0, 0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (at, steps)}


def test_a_long_stream(spark):
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("down"), F.col("id").cast("double").alias("z"), F.lit(1.0).alias("step"))
    members, links = terrain.stream_links(rows, 10)
    row = links.first()
    assert links.count() == 1 and (row["link"], row["last"], row["cells"], row["length"], row["drop"], row["strahler"]) == (n - 10, 0, n - 9, float(n - 10), float(n - 10), 1)
    assert members.agg(F.max("place")).first()[0] == n - 10


def test_rings_are_ranked_with_their_search(spark, monkeypatch):
    """A ring's smallest side and the steps to it come from the same rounds; drawing needs no rings."""
    import __spark_entry__ as entry

    followed, descend = [], terrain.descend
    monkeypatch.setattr(terrain, "descend", lambda edges: followed.append(set(edges.columns)) or descend(edges))
    grid = {(r, c): 1.0 for r in range(5) for c in range(4) if (r, c) not in ((1, 1), (2, 2))}
    points = terrain.outlines(table(spark, grid).select("row", "col", F.lit(7).alias("region"))).collect()
    assert not followed and sorted((p["hole"], p["place"]) for p in points) == [(False, k) for k in range(18)] + [(True, k) for k in range(8)]
    monkeypatch.setattr(terrain, "outlines", None)
    assert entry.queries()["snk_31"](spark, "/root/testdata/sf0.001").count() > 0
