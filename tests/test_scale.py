"""Rounding as the SQL rounds, and the ways that keep large tables out of one task."""

import duckdb
from pyspark.sql import functions as F


def test_scores_are_rounded_twice(spark):
    from catchment.functions.text import binary_round

    numbers = [-5.825074999, 5.825074999, -3.768984996, 1.005, -2.675, 0.0, 1234.500005, None] + [-k / 200000 for k in range(1, 400, 2)]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double")
    got = [r["y"] for r in table.select("k", binary_round(binary_round(F.col("x"), 8), 5).alias("y")).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(round(?::DOUBLE, 8), 5)", [x]).fetchone()[0] for x in numbers]
    assert got[0] == -5.82508


def test_three_digits_of_ties(spark):
    from catchment.sources import writers

    numbers = [1845.0, 1855.0, 1885.0, 0.0004995, 0.0005005, 2.675, 1.005, 0.125, 0.0625, 12.25, 100.5, 101.5, -1845.0]
    table = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in table.select(writers.three_digits(F.col("x"))).collect()] == [f"{x:.3g}" for x in numbers]


def test_pairs_below(spark):
    from catchment.operators import relational

    low, high = [None, 3, 3, 7, -2, 40, 12, 12], [3, 4, None, 4, 12, 41, -2, 0]
    table = lambda values: spark.createDataFrame([(x,) for x in values], "value long")
    got = relational.pairs_below(table(low), table(high))
    assert got.collect()[0]["n"] == sum(a < b for a in low for b in high if a is not None and b is not None)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert relational.pairs_below(table(low).limit(0), table(high)).collect()[0]["n"] == 0


def test_nearest_of_list_by_cells(spark):
    import random

    from catchment.operators import nearest

    rng = random.Random(5)
    points = [(k, rng.uniform(-2, 2), rng.uniform(-2, 2), k % 4 if k % 9 else None) for k in range(300)]
    listed = [(k, round(rng.uniform(-1, 1), 2), round(rng.uniform(-1, 1), 1), k % 3) for k in range(400)] + [(900, 50.0, 50.0, 7), (901, None, 1.0, 0)]
    want = {}
    for k, x, y, g in points:
        near = [((x - a) ** 2 + (y - b) ** 2, s) for s, a, b, h in listed if h == g and a is not None and g is not None]
        if near:
            want[k] = min(near)[1]
    got = nearest.nearest_of_list(spark.createDataFrame(points, "id int, x double, y double, g int"), spark.createDataFrame(listed, "station int, sx double, sy double, g int"), "g")
    assert {r["id"]: r["station"] for r in got.collect()} == want


def test_nearest_meets_arrays(spark):
    """No row for each pair of point and station is made and sorted: an array of stations a row."""
    from catchment.operators.nearest import nearest

    points = spark.range(50).select("id", (F.col("id") / 50).alias("x"), (F.col("id") % 7 / 7).alias("y"))
    stations = spark.range(40).select(F.col("id").alias("station"), (F.col("id") / 40).alias("sx"), (F.col("id") % 3 / 3).alias("sy"))
    assert "array_min" in nearest(points, stations)._jdf.queryExecution().toString()


def test_steps_in_wide_form(spark):
    from catchment.operators import sampling as sa

    runs = spark.createDataFrame([(1, 2.0, 3.0), (2, -1.0, None), (3, 0.5, 8.0)], "run int, a double, b double")
    wide = sa.steps_of_runs(runs, ["a", "b"], 0.1)
    got = sorted((r["run"], r["step"], p, r[p]) for r in wide.collect() for p in "ab")
    want = sorted((r["run"], r["step"], r["param"], r["value"]) for r in sa.one_at_a_time(runs.unpivot("run", ["a", "b"], "param", "value"), 0.1).collect())
    assert got == want
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    outputs = wide.selectExpr("run", "step", "param", "base", "a * b as y", "before.a * before.b as before")
    for effects in (sa.elementary_effects, sa.perturbation_sensitivities):
        assert sorted(map(str, effects(outputs, 0.1).collect())) == sorted(map(str, effects(outputs.drop("before"), 0.1).collect()))


def test_sobol_points(spark):
    from catchment.operators import sampling

    long = {(r["id"], r["dimension"]): r["u"] for r in sampling.sobol_points(spark.range(70), "id", 40).collect()}
    wide = spark.range(70).select("id", *[sampling.sobol(F.col("id"), k).alias(str(k)) for k in range(40)]).collect()
    assert long == {(r["id"], k): r[str(k)] for r in wide for k in range(40)}
    assert "lambda" not in sampling.sobol_points(spark.range(70), "id", 40)._jdf.queryExecution().optimizedPlan().toString()


def _forest(seed, n):
    import random

    rng = random.Random(seed)
    return [(k, rng.randrange(max(0, k - 6), k) if rng.random() < 0.97 else None) for k in range(1, n)]


def test_trails(spark):
    from catchment.operators import network

    rows = _forest(3, 300)
    below = {k: d for k, d in rows if d is not None}

    def way(k):
        out = [k]
        while out[-1] in below:
            out.append(below[out[-1]])
        return out

    table = spark.createDataFrame(rows, "node long, down long")
    nodes = {k for k, _ in rows} | {d for _, d in rows if d is not None}
    assert {r["node"]: r["path"] for r in network.paths(table).collect()} == {k: way(k) for k in nodes}
    reach = network.closure(table)
    assert sorted(map(tuple, reach.collect())) == sorted((k, d, n) for k in nodes for n, d in enumerate(way(k)) if n)
    assert "Aggregate" not in reach._jdf.queryExecution().optimizedPlan().toString()
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node long, down long")
    assert sorted(map(tuple, network.closure(ring).collect())) == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 2)]


def test_strahler_of_forests(spark):
    from catchment.operators import network

    rows = _forest(8, 250) + [(1000, 1001), (1001, 1000), (1002, 1000), (5, 3)]
    links = {(k, d) for k, d in rows if d is not None}
    nodes = {k for k, _ in rows} | {d for _, d in links}
    want, left = {}, set(nodes)
    while ready := {k for k in left if all(u in want for u, d in links if d == k)}:
        for k in ready:
            above = sorted((want[u] for u, d in links if d == k), reverse=True)
            want[k] = 1 if not above else above[0] + (len(above) > 1 and above[0] == above[1])
        left -= ready
    got = network.strahler(spark.createDataFrame(rows, "node long, down long"))
    assert {r["node"]: r["strahler"] for r in got.collect()} == want and dict(got.dtypes)["strahler"] == "int"


def test_pairs_of_a_key_are_made_last(spark, tmp_path):
    """All pairs, none by a row in a shuffle; written, they take little more room than the blocks they come from."""
    from catchment.operators import relational

    table = lambda rows, name: spark.createDataFrame(rows, f"k long, {name} long")
    left = [(k % 3, k if k % 11 else None) for k in range(90)] + [(None, 500), (7, 501), (1, 4), (1, 4)]
    right = [(k % 4, k if k % 13 else None) for k in range(70)] + [(None, 600), (8, 601)]
    got = relational.pairs_of_key(table(left, "a"), table(right, "b"), "k", "a", "b", 8, 4, 50)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((a, b)) for k, a in left for m, b in right if k == m and k is not None)
    assert relational.pairs_of_key(table(left, "a").limit(0), table(right, "b"), "k", "a", "b").count() == 0
    ids = lambda name, n: spark.range(n).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 7919 % 1000003).alias(name))
    relational.pairs_of_key(ids("a", 3000), ids("b", 2000), "k", "a", "b").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 6_000_000
    # A byte a pair would be 6 MB; joined row by row they take over 15.
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 3_000_000


def test_runs_of_pairs_end_with_a_byte(spark, tmp_path):
    """Runs of any length hold all pairs; written, those of a tile that isn't a multiple of 8 long recur as well."""
    from catchment.operators import relational

    ids = lambda name, n: spark.range(n).select((F.col("id") % 3).alias("k"), F.col("id").alias(name))
    for n, m in ((1, 1), (20, 21), (50, 24), (60, 3 * 7), (70, 3 * 264), (49, 3 * 521)):
        got = relational.pairs_of_key(ids("a", n), ids("b", m), "k", "a", "b")
        assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(n) for b in range(m) if a % 3 == b % 3]
    one = lambda name, n: spark.range(n).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 7919 % 1000003).alias(name))
    relational.pairs_of_key(one("a", 4000), one("b", 1003), "k", "a", "b").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 4000 * 1003
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 500_000


def test_tiles_grow_with_the_pairs_of_a_task(spark, tmp_path):
    """Blocks aren't repeated for every small tile where a task has room for more; tiles of 8 would be written in over half a byte a pair."""
    from catchment.operators import relational

    one = lambda name, n: spark.range(n).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 7919 % 1000003).alias(name))
    relational.pairs_of_key(one("a", 4000), one("b", 1000), "k", "a", "b", tile=8).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 800_000
