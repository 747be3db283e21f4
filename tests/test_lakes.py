"""Lakes on streams against a walk over Python dictionaries."""

import numpy as np
import pytest

from catchment.operators import lakes

STREAMS = "node long, down long, link long, place int, z double, area long"


def network(seed, n=260):
    """A random tree that drains to 0, with links and areas, and lakes over spans of cells."""
    r = np.random.default_rng(seed)
    down = {k: None if k == 0 else int(r.integers(max(0, k - 4), k)) for k in range(n)}
    ups = {k: [u for u in down if down[u] == k] for k in down}
    area = {}
    for k in sorted(down, reverse=True):
        area[k] = 1 + sum(area[u] for u in ups[k])
    place = {}
    for k in (k for k in down if len(ups[k]) != 1):
        at, i, link = k, 0, k
        while True:
            place[at] = (link, i)
            at, i = down[at], i + 1
            if at is None or len(ups[at]) != 1:
                break
    z = {k: float(r.integers(0, 500)) for k in down}
    water = [(int(k), int(lake), bool(lake % 7 == 3)) for lake in range(1, 16) for k in r.choice(n + 20, 3) for k in range(k, k + int(r.integers(1, 9)))]
    return down, ups, area, place, z, water


def brute(down, ups, area, place, z, water, share):
    lake = {}
    for k, name, playa in water:
        if not playa:
            lake[k] = max(name, lake.get(k, name))
    reach = {}
    for k in sorted(down, key=lambda k: place[k]):
        before = [u for u in ups[k] if place[u][0] == place[k][0] and lake.get(u) == lake.get(k)]
        reach[k] = reach[before[0]] if before else k
    last = {reach[k]: k for k in sorted(down, key=lambda k: place[k])}
    following = {r: reach.get(down[k]) for r, k in last.items()}
    inside = {r: lake.get(r) for r in last}
    main = {}
    for r, k in last.items():
        if inside[r] is not None and (following[r] is None or inside[following[r]] != inside[r]):
            if inside[r] not in main or (-area[k], k) < (-area[last[main[inside[r]]]], last[main[inside[r]]]):
                main[inside[r]] = r
    below = {}
    for name, r in main.items():
        below.setdefault(following[r], []).append(name)
    taken = {}
    for r, names in below.items():
        if r is None or len(names) > 1 or inside[r] is not None or following[r] is None or inside[following[r]] is not None:
            continue
        own = area[last[r]] - sum(area[last[u]] for u in last if following[u] == r)
        if own < share * sum(v == names[0] for v in lake.values()):
            taken[r] = names[0]
    inside |= taken

    def way(r):
        after = following[r]
        return ("X", last[r]) if after is None else ("RES", inside[after]) if inside[after] is not None else ("CH", after)

    routing = {("CH", r): way(r) for r in last if inside[r] is None}
    for name, r in main.items():
        routing["RES", name] = ("X", last[r]) if following[r] is None else way(following[r]) if following[r] in taken else way(r)
    return lake, reach, inside, main, following, last, routing


@pytest.mark.parametrize("seed", range(3))
def test_add_lakes(spark, seed):
    down, ups, area, place, z, water = network(seed)
    streams = spark.createDataFrame([(k, down[k], *place[k], z[k], area[k]) for k in down], STREAMS)
    reaches, routing, table = lakes.add_lakes(streams, spark.createDataFrame(water, "node long, lake int, playa boolean"), 0.6)
    lake, reach, inside, main, following, last, want = brute(down, ups, area, place, z, water, 0.6)
    assert {r["reach"]: (r["lake"], r["inside"], r["last"], r["next"], r["cells"]) for r in reaches.collect()} == {
        r: (lake.get(r), inside[r], last[r], following[r], sum(v == r for v in reach.values())) for r in last
    }
    got = {(r["source_cat"], r["source"]): (r["sink_cat"], r["sink"]) for r in routing.collect()}
    assert got == want and routing.count() == len(want) and any(k == "RES" for k, _ in want.values())
    # No loops: every way ends at an outlet.
    for at in got:
        steps = 0
        while at[0] != "X":
            at, steps = got[at], steps + 1
            assert steps <= len(got)
    for r in table.collect():
        name = r["lake"]
        inlets = [x for x in last if inside[x] is None and following[x] is not None and inside[following[x]] == name]
        assert r["inlets"] == (0 if r["playa"] else len(inlets)) and r["within"] == sum(v == name for v in inside.values())
        assert r["outlet"] == (last[main[name]] if name in main else None)
        heights = [z[last[x]] for x in inlets] or [z[r["outlet"]]] if name in main else [None]
        assert r["z"] is None if heights == [None] else abs(r["z"] - sum(heights) / len(heights)) < 1e-9


def test_lakes_of_odd_rows(spark):
    streams = spark.createDataFrame([(3, 2, 3, 0, 9.0, 1), (2, 1, 3, 1, 8.0, 2), (1, None, 3, 2, None, 3)], STREAMS)
    rows = [(2, 5, False), (2, 5, False), (2, 4, None), (None, 6, False), (2, None, False), (99, 7, False), (3, 8, True)]
    reaches, routing, table = lakes.add_lakes(streams, spark.createDataFrame(rows, "node long, lake int, playa boolean"))
    assert sorted(tuple(r)[:4] for r in routing.collect()) == [("CH", 1, "X", 1), ("CH", 3, "RES", 5), ("RES", 5, "CH", 1)]
    found = {r["lake"]: (r["cells"], r["inlets"], r["within"], r["outlet"], r["z"]) for r in table.collect()}
    assert found == {4: (0, 0, 0, None, None), 5: (1, 1, 1, 2, 9.0), 7: (1, 0, 0, None, None), 8: (1, 0, 0, None, None)}
    none = spark.createDataFrame([], "node long, lake int, playa boolean")
    assert [tuple(r)[:4] for r in lakes.add_lakes(streams, none)[1].collect()] == [("CH", 3, "X", 1)]
    assert [x.count() for x in lakes.add_lakes(streams.limit(0), none)] == [0, 0, 0]
    basins = spark.createDataFrame([(3, 30), (2, 30), (1, None)], "node long, basin long")
    assert {tuple(r) for r in lakes.lake_basins(basins, spark.createDataFrame(rows, none.schema)).collect()} == {(30, 2, 1), (None, 1, 0)}


def test_points_to_the_perimeter(spark):
    cells = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, None), (10, 11), (11, 10)], "node long, down long")
    water = spark.createDataFrame([(k, 1, False) for k in (5, 4, 3, 10, 11)], "node long, lake int, playa boolean")
    points = spark.createDataFrame([(1, 5), (2, 4), (3, 3), (4, 2), (5, 10), (6, None)], "point int, node long")
    got = {r["point"]: (r["lake"], r["moved"], r["found"]) for r in lakes.to_perimeter(points, cells, water, 1).collect()}
    assert got == {1: (1, 5, False), 2: (1, 3, True), 3: (1, 3, True), 4: (None, 2, None), 5: (1, 10, False), 6: (None, None, None)}


def test_lake_queries_sum_areas_once(spark, monkeypatch):
    """What drains through a cell is summed once for links and lakes, and the links' orders, which nobody reads, not at all."""
    import __spark_entry__ as entry
    from catchment.operators import terrain

    calls, upstream = [], terrain.upstream
    monkeypatch.setattr(terrain, "upstream", lambda *a: calls.append("areas") or upstream(*a))
    monkeypatch.setattr(terrain, "strahler", lambda *a: calls.append("orders"))
    assert entry.queries()["gs_24"](spark, "/root/testdata/sf0.001").count() > 0 and calls == ["areas"]
