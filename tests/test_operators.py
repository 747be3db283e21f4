"""Operators that SQL can't express, edge cases, and round trips."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchment.functions import dates, text
from catchment.operators import checks, landunits, metrics, network, relational, sampling, schema, timeseries
from catchment.operators.nearest import nearest
from catchment.sources import text as source
from catchment.sources import writers


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_identical_series_fit_perfectly(spark):
    pairs = spark.createDataFrame([(k, float(k * k + 1), float(k * k + 1)) for k in range(1, 20)], "t int, o double, m double")
    got = metrics.fit(pairs, "t").first().asDict()
    assert got["NSE"] == got["RCOEF"] == pytest.approx(1) and got["RMSE"] == got["PBIAS"] == 0 and got["INF_IOA"] == 1


def test_fit_by_series_and_nulls(spark):
    pairs = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 3.0, 3.0), ("b", 1, 5.0, None), ("b", 2, 4.0, 5.0)], "s string, t int, o double, m double")
    got = {r["s"]: r["MAE"] for r in metrics.fit(pairs, "t", ["MAE"], ["s"]).collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_strahler_against_recursion(spark):
    edges = [(k, (k - 1) // 2) for k in range(1, 25)] + [(25, 24), (26, 25), (27, 3)]
    above = {}
    for node, down in edges:
        above.setdefault(down, []).append(node)

    def order(n):
        up = sorted(order(x) for x in above.get(n, []))
        return 1 if not up else up[-1] + (len(up) > 1 and up[-1] == up[-2])

    got = dict(values(network.strahler(spark.createDataFrame(edges, "node long, down long")), "node", "strahler"))
    assert got == {n: order(n) for n in range(28)}


def test_closure_of_a_loop_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "node long, down long")
    assert values(network.loops(edges), "node") == [(1,), (2,), (3,)]


def test_pass_through_chain(spark):
    rows = [(1, "CH", 2, "PT", "tot", 100.0), (2, "PT", 3, "PT", "tot", 70.0), (3, "PT", 4, "CH", "sur", 30.0)]
    edges = spark.createDataFrame(rows, "source long, source_cat string, sink long, sink_cat string, hyd_typ string, percent double")
    assert values(network.skip_points(edges), "source", "sink", "hyd_typ", "percent", "order") == [(1, 4, "sur", 30.0, 1)]


def test_thresholds_keep_area_and_one_part(spark):
    rows = [(1, "a", "s", "x", 1.0), (1, "b", "s", "x", 2.0), (1, "b", "t", "x", 3.0), (2, "a", "s", "y", 5.0)]
    units = spark.createDataFrame(rows, "unit int, crop string, soil string, slope string, area double")
    for got in (landunits.threshold(units, 90, 90, 90), landunits.remove_smallest(units, 2.5), landunits.remove_to_target(units, 2)):
        assert dict(values(got.groupBy("unit").agg(F.sum("area").alias("a")), "unit", "a")) == pytest.approx({1: 6.0, 2: 5.0})
    kept = landunits.threshold(units, 50, 0, 0, exempt=["a"])
    assert values(kept.select("crop").distinct(), "crop") == [("a",), ("b",)]


def test_run_lists(spark):
    ids = spark.createDataFrame([("k", x) for x in (1, 2, 3, 7, 9, 10)], "k string, o int")
    assert landunits.runs(ids, ["k"], "o").first()["elements"] == "1,-3,7,9,-10"


def test_nearest_ways_agree(spark):
    points = spark.createDataFrame([(k, math.sin(k) * 9, math.cos(k * 3) * 9) for k in range(60)] + [(99, 500.0, 0.0)], "id int, x double, y double")
    stations = spark.createDataFrame([(k, math.sin(k * 7) * 8, math.cos(k * 5) * 8) for k in range(40)], "station int, sx double, sy double")
    for weighted in (False, True):
        assert values(nearest(points, stations, weighted), "id", "station") == values(nearest(points, stations, weighted, small=0), "id", "station")


def test_periods():
    assert timeseries.period_lengths(date(2000, 1, 1), date(2001, 12, 31)) == (731, 24.0, 2.0)


def test_one_year_period_has_no_finish(spark):
    df = spark.createDataFrame([(2000, k) for k in (5, 20, 300)], "y int, j int")
    assert df.where(dates.in_period(F.col("y"), F.col("j"), (2000, 10), (2000, 30))).count() == 2


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.human_duration(F.lit(90061)).alias("a"), text.human_duration(F.lit(0)).alias("b"), text.file_extension(F.lit("d.x/.profile")).alias("c"), text.file_extension(F.lit("a/b.tar.gz")).alias("d"), text.significant(F.lit(0.0), 3).alias("e")
    ).first()
    assert row == ("1 day, 1 hour, 1 minute, 1 second", "0 seconds", "", ".gz", 0.0)


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, "a*c"), (2, "abc"), (3, None)], "id int, s string")
    assert values(df.where(relational.glob(F.col("s"), "a[*]c")), "id") == [(1,)]
    assert df.where(relational.among(F.col("id"), [])).count() == 0 and df.where(relational.not_among(F.col("id"), [])).count() == 3
    new = spark.createDataFrame([(2, "new"), (9, "nine")], "id int, s string")
    assert values(relational.upsert(df.where("id < 3"), new, ["id"], ["s"]), "id", "s") == [(1, "a*c"), (2, "new"), (9, "nine")]
    assert values(relational.changes(df.where("id < 3"), new, ["id"]), "id", "action") == [(1, "DELETE"), (2, "UPDATE"), (9, "INSERT")]


def test_normal_inverse_and_hypercube(spark):
    got = spark.createDataFrame([(0.5,), (0.975,), (0.001,), (1.0,)], "p double").select(sampling.normal_inverse(F.col("p")).alias("z")).collect()
    assert [None if r["z"] is None else round(r["z"], 5) for r in got] == [0.0, 1.95996, -3.09023, None]
    cube = sampling.latin_hypercube(spark, 50, [("a", 0.0, 1.0), ("b", -1.0, 1.0)], 3)
    assert cube.groupBy("param").agg(F.count_distinct("stratum").alias("n")).where("n <> 50").isEmpty()


def test_regression(spark):
    df = spark.createDataFrame([(float(k), math.sin(k), 3.0 * k + math.sin(k)) for k in range(40)], "a double, b double, y double")
    _, r2 = sampling.regression_coefficients(df, ["a", "b"], "y")
    assert r2 == pytest.approx(1)


def test_rules(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (None,)], "x double")
    got = checks.warn(df, [("x", "<", 0.31, "low"), ("x", ">", 0.4, "high")]).collect()
    assert [r["warnings"] for r in got] == [["low"], ["high"], []]


def test_output_file_round_trip(spark, tmp_path):
    file = tmp_path / "hru_wb_day.txt"
    file.write_text("title\njday mon day yr unit gis_id name precip\nnone none none none none none none mm\n1 1 1 2000 1 0 hru007 3.5\n2 1 2 2000 1 5 hru5 ****\n3 1 3 2000\n")
    form = T.StructType([*source.PREFIX.fields, T.StructField("precip", T.DoubleType())])
    got = source.read_output(spark, str(file), form).orderBy("jday").collect()
    assert [(r["gis_id"], r["precip"]) for r in got] == [(7, 3.5), (5, None), (None, None)]
    units = {r["name"]: r["units"] for r in source.column_units(spark, str(file)).collect()}
    assert units["precip"] == "mm"


def test_station_files(spark, tmp_path):
    for k, first in enumerate((1, 3)):
        (tmp_path / f"s{k}.pcp").write_text("a\nb\n1 0 10.5 20.5 100\n" + "".join(f"2000 {d} {d / 2}\n" for d in range(first, 60)))
    series = source.read_station(spark, str(tmp_path / "*.pcp"))
    window = source.common_window(series, "path").first()
    assert (window["start"], window["finish"]) == (date(2000, 1, 3), date(2000, 2, 28))
    assert source.station_places(spark, str(tmp_path / "*.pcp")).first()["lat"] == 10.5


def test_dense_and_tables(spark, tmp_path):
    (tmp_path / "d.txt").write_text("20000228\n1\n2\n3\n")
    assert values(source.read_dense(spark, str(tmp_path / "d.txt")), "date", "value") == [(date(2000, 2, 28), 1.0), (date(2000, 2, 29), 2.0), (date(2000, 3, 1), 3.0)]
    (tmp_path / "t.csv").write_text("name;x\nAbc;1,5\nD;null\n")
    form = T.StructType([T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    assert [tuple(r) for r in source.read_table(spark, str(tmp_path / "t.csv"), form, ";", decimal_comma=True).collect()] == [("abc", 1.5), ("d", None)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nb", 1.5), (1, None, None)], "id int, name string, x double")
    for kind in ("csv", "tsv", "json"):
        writers.export(df, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    writers.write_fixed(df, str(tmp_path / "fixed"), [("id", "int", 4), ("name", "string", 6), ("x", "double", 9)], ["id"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "fixed")).collect()][1] == "   1  null         null"


def test_migrations(spark):
    df = spark.createDataFrame([(1, "2")], "id int, n string")
    chain = [("1.0", "1.1", [("alter", "n", "int")]), ("1.1", "1.2", [("rename", "n", "size"), ("add", "note", "string")])]
    got, version = schema.upgrade(df, "1.0", chain)
    assert version == "1.2" and got.schema.simpleString() == "struct<id:int,size:int,note:string>"


def test_stream_matches_batch(spark, tmp_path):
    from catchment.streaming import daily

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = daily.window_means(events, "ts", "event_type", "value").count()
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    query = daily.window_means(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").count() == batch


def test_optimiser_and_breaks(spark):
    from catchment.operators import calibration

    best, score = calibration.shuffled_complexes(spark, lambda x: x[0] * x[0] + (x[1] - 1) * (x[1] - 1), [-2, -2], [2, 2], complexes=2, rounds=25)
    assert score < 0.05 and abs(best[1] - 1) < 0.3
    assert calibration.jenks([1, 1, 2, 10, 11, 50], 3) == [2.0, 11.0, 50.0] and calibration.jenks([], 3) == [] and calibration.jenks([4, 4], 3) == [4.0]
    data = spark.createDataFrame([("a", float(k % 7 + 100 * (k % 3))) for k in range(500)], "k string, v double")
    few, many = (calibration.natural_breaks(data, ["k"], "v", 3, points).first()["breaks"] for points in (1000, 10))
    assert few == [6.0, 106.0, 206.0] and many[-1] == 206.0 and len(many) == 3


def test_lines_are_numbered_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = writers.fixed_lines(df, [("id", "int", 4)], ["id"]).withColumn("task", F.spark_partition_id()).where("place > 0").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["place"], int(r["value"])) for r in got) == [(k + 1, k) for k in range(1000)]
    assert len({r["task"] for r in got}) > 1
    assert [r["place"] for r in writers.fixed_lines(df.limit(0), [("id", "int", 4)], ["id"]).collect()] == [0]


def test_whole_tables(spark):
    import __spark_entry__ as entry

    counts = {n: entry.queries()[n](spark, "/root/testdata/sf0.001").count() for n in ("snk_3", "src_15", "sa_31", "jn_27", "jn_31")}
    rows = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").count() for n in ("part", "customer", "orders", "embeddings")}
    assert counts.pop("jn_31") > 0 and counts == {"snk_3": rows["part"] + 1, "src_15": rows["customer"], "sa_31": rows["orders"], "jn_27": rows["embeddings"]}


def test_breaks_count_every_row(spark):
    from itertools import combinations, pairwise

    from catchment.operators import calibration

    many = {float(x): 1 + 400 * (x in (1, 9, 39, 60)) for x in (1, 2, 3, 4, 9, 17, 18, 30, 39, 40, 41, 55, 60, 90)}
    rows = [("a", x) for x, n in many.items() for _ in range(n)] + [("b", None)]
    keys = sorted(many)

    def spread(part):
        n, mean = sum(many[x] for x in part), sum(x * many[x] for x in part) / sum(many[x] for x in part)
        return sum(many[x] * (x - mean) ** 2 for x in part) if n else 0

    ways = [[0, *way, len(keys)] for way in combinations(range(1, len(keys)), 3)]
    best = min(ways, key=lambda way: sum(spread(keys[i:j]) for i, j in pairwise(way)))
    data = spark.createDataFrame(rows, "k string, v double")
    for points in (1000, 5):
        got = {r["k"]: r["breaks"] for r in calibration.natural_breaks(data, ["k"], "v", 4, points).collect()}
        assert got == {"a": [keys[j - 1] for j in best[1:]], "b": []} and got["a"] != calibration.jenks(keys, 4)


def test_morris_changes_one_parameter_a_step(spark):
    from catchment.operators import calibration

    walk = calibration.morris(spark, [("a", 0.0, 1.0), ("b", 0.0, 10.0)], 8, seed=1)
    rows = {(r["run"], r["step"], r["name"]): r for r in walk.collect()}
    for (run, step, name), r in rows.items():
        if step:
            assert (r["value"] != rows[run, step - 1, name]["value"]) == (r["param"] == name)


def test_documents(spark):
    from catchment.functions import documents

    df = spark.createDataFrame([(1, '{"a":{"b":[1,2]},"c":null}'), (2, None)], "id int, d string")
    row = df.select(documents.patch(F.col("d"), F.lit('{"a":{"b":null,"x":1}}')).alias("p"), documents.holds(F.col("d"), F.lit('{"a":{"b":[2]}}')).alias("h")).collect()
    assert [tuple(r) for r in row] == [('{"a":{"x":1},"c":null}', True), (None, None)]
    assert values(documents.tree(df, "id", "d"), "path") == [("$",), ("$.a",), ("$.a.b",), ("$.a.b[0]",), ("$.a.b[1]",), ("$.c",)]


def test_model_report(spark):
    from catchment.operators import model_rules

    names = "precip surq latq flo et cn denit fertn fertp nplt pplnt sedorgn surqno3 lat3no3 sedorgp surqsolp strsp strsn strsw yld bioms".split()
    calm = dict(zip(names, (1000.0, 130.0, 30.0, 100.0, 600.0, 60.0, 10.0, 100.0, 10.0, 60.0, 6.0, 10.0, 2.0, 1.0, 1.0, 0.5, 10.0, 10.0, 10.0, 2.0, 5.0)))
    wild = calm | {"precip": 50.0, "surq": 0.0, "latq": 5.0, "flo": 1.0, "denit": 0.0, "nplt": 40.0, "strsn": 61.0, "sedorgn": 34.0}
    bare = calm | dict.fromkeys(["surq", "latq", "flo", "precip", "fertn", "fertp"], 0.0)
    rows = spark.createDataFrame([tuple(x[n] for n in names) for x in (calm, wild, bare)], ", ".join(f"{n} double" for n in names))
    got = model_rules.report(rows).collect()
    assert not any(got[0][s] for s in ("hydrology", "nitrogen", "phosphorus", "plants", "landscape"))
    assert got[1]["hydrology"][0].startswith("Precipitation too small") and "Lateral flow is greater" in " ".join(got[1]["hydrology"])
    assert len(got[1]["nitrogen"]) == 2 and got[1]["plants"] == ["More than 100 days of nitrogen stress"]
    assert "Groundwater" not in " ".join(got[2]["hydrology"]) and "Surface runoff ratio may be low (< 0.2)" in got[2]["hydrology"] and not got[2]["nitrogen"]


def test_long_chain_of_nodes(spark):
    """A chain of 100,000 nodes, on which all pairs would be five thousand million."""
    n = 100_000
    chain = spark.range(1, n).select(F.col("id").alias("node"), (F.col("id") - 1).alias("down"))
    own = spark.range(n).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("x"))
    assert network.upstream_sum(chain, own, "x").where(F.col("total") != n - F.col("node")).isEmpty()
    found = network.descend(chain, lengths=own.withColumnRenamed("x", "length"))
    assert found.where((F.col("target") != 0) | (F.col("steps") != F.col("node")) | (F.col("length") != F.col("node"))).isEmpty() and found.count() == n - 1
    pairs = spark.createDataFrame([(7, 90_000), (99_999, 99_998), (5, 5)], "a long, b long")
    assert sorted(map(tuple, network.meeting(chain, pairs).collect())) == [(5, 5, 5, 0), (7, 90_000, 7, 89_993), (99_999, 99_998, 99_998, 1)]


def test_networks_with_loops(spark):
    """1, 2, 3 is a loop, 4 drains into it and 5 into 4; 7 drains to the outlet 6, and 8 has none."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (7, 6), (8, None), (None, 1), (7, 6)], "node long, down long")
    own = spark.createDataFrame([(k, 1) for k in range(1, 9)], "node long, x long")
    assert sorted(r["node"] for r in network.loops(edges).collect()) == [1, 2, 3]
    assert dict(network.upstream_sum(edges, own, "x").collect()) == {1: None, 2: None, 3: None, 4: 2, 5: 1, 6: 2, 7: 1, 8: 1}
    assert dict(network.final_target(edges).collect()) == {1: None, 2: None, 3: None, 4: None, 5: None, 7: 6, 8: None}
    assert [tuple(r) for r in network.descend(edges, lambda x: x == 2).collect() if r["node"] != 2] and {r["node"] for r in network.descend(edges, lambda x: x == 2).collect()} == {1, 2, 3, 4, 5}
    split = edges.unionByName(spark.createDataFrame([(7, 8)], "node long, down long"))
    assert sorted(r["node"] for r in network.loops(split).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        network.upstream_sum(split, own, "x")
    points = [("a", "CH", "p", "PT", "h", 100.0), ("p", "PT", "q", "PT", "h", 100.0), ("q", "PT", "p", "PT", "h", 50.0), ("q", "PT", "z", "X", "s", 50.0), ("b", "CH", "r", "PT", "h", 1.0), ("r", "PT", "r", "PT", "h", 1.0)]
    got = network.skip_points(spark.createDataFrame(points, "source string, source_cat string, sink string, sink_cat string, hyd_typ string, percent double")).collect()
    assert {(r["source"], r["sink"], r["percent"]) for r in got} == {("a", "z", 50.0)}
    empty = spark.createDataFrame([], "node long, down long")
    assert network.descend(empty).count() == 0 and network.loops(empty).count() == 0 and network.upstream_sum(empty, own, "x").count() == 8


def test_nearest_of_odd_rows(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1e9, -1e9), (5, 3.0, 4.0), (5, 3.0, 4.0), (6, float("inf"), 0.0), (7, 50.0, 2.0)], "id long, x double, y double")
    rows = [(k, float(k % 7), float(k // 7 % 5)) for k in range(70)] + [(900, None, 1.0), (901, float("nan"), 0.0), (902, 100.0, 2.0)]
    stations = spark.createDataFrame(rows, "station long, sx double, sy double")
    want = [(1, 0, 0.0), (4, 902, pytest.approx(2e18)), (5, 31, 0.0), (7, 6 + 14, 44.0**2)]
    for weighted in (False, True):
        ways = [values(nearest(points, stations, weighted, small=k), "id", "station", "d2") for k in (1000, 0)]
        assert [r[:2] for r in ways[0]] == [r[:2] for r in ways[1]] and (weighted or ways[0] == want)
    for small in (1000, 0):
        assert nearest(points.limit(0), stations, small=small).count() == 0 and nearest(points, stations.limit(0), small=small).count() == 0
        assert values(nearest(points, stations, limit=0.5, small=small), "id") == [(1,), (5,)]
    # A crowd of stations at one place and far single ones.
    crowd = spark.range(3000).selectExpr("id AS station", "IF(id < 2500, 1.0, id * 1.0) AS sx", "IF(id < 2900, 1.0 + id % 3, id * 7.0) AS sy")
    some = spark.range(300).selectExpr("id", "id * 13.7 % 3100 - 50 AS x", "id * 211.3 % 22000 AS y")
    assert values(nearest(some, crowd, small=0), "id", "station") == values(nearest(some, crowd, small=5000), "id", "station")


def test_breaks_by_blocks_are_those_of_one_search(spark):
    from catchment.operators import calibration

    r = np.random.default_rng(4)
    rows = [(k, float(x)) for k, n in (("a", 150), ("b", 40), (None, 90)) for x in np.round(r.gamma(2, 30, n), 2)] + [("b", None), ("b", float("nan")), ("c", None), ("d", 1.5)]
    data = spark.createDataFrame(rows, "k string, v double")
    for classes in (1, 4):
        want = {x["k"]: x["breaks"] for x in calibration.natural_breaks(data, ["k"], "v", classes).collect()}
        got = {x["k"]: x["breaks"] for x in calibration.natural_breaks(data, ["k"], "v", classes, most=50, block=16).collect()}
        assert got == want and want["c"] == [] and want["d"] == [1.5] and len(want["a"]) == classes


def test_breaks_of_a_very_large_group(spark):
    from catchment.operators import calibration

    n = 100_000
    data = spark.range(n).select(F.col("id").cast("double").alias("v"))
    # Equal steps are cut into equal parts.
    (row,) = calibration.natural_breaks(data, [], "v", 4, most=1000, block=1 << 14).collect()
    assert row["breaks"] == [n / 4 - 1, n / 2 - 1, 3 * n / 4 - 1, n - 1]


def test_smallest_parts_go_one_at_a_time(spark):
    r = np.random.default_rng(8)
    rows = [(u, f"c{i % 3}", f"s{i}", "x", float(a)) for u in range(12) for i, a in enumerate(np.round(r.gamma(1.0, 4.0, 9), 1))]
    rows += [(20, "c0", "s", "x", 0.5), (21, "c0", "s", "x", 0.0), (21, "c1", "s", "x", 0.0), (22, "c1", "s", "x", None), (22, "c1", "t", "x", 1.0)]
    for exempt in (None, ["c1"]):
        want = set()
        for unit in {x[0] for x in rows}:
            parts = {x[1:4]: x[4] for x in rows if x[0] == unit}
            while len(parts) > 1:
                small = sorted((a, k) for k, a in parts.items() if a is not None and a < 5 and k[0] not in (exempt or []))
                if not small:
                    break
                total = sum(a or 0 for a in parts.values())
                del parts[small[0][1]]
                rest = sum(a or 0 for a in parts.values())
                parts = {k: a and a * total / rest if rest else a for k, a in parts.items()}
            want |= {(unit, *k, a if a is None else round(a, 6)) for k, a in parts.items()}
        got = landunits.remove_smallest(spark.createDataFrame(rows, "unit int, crop string, soil string, slope string, area double"), 5, exempt)
        assert {(*x[:4], x[4] if x[4] is None else round(x[4], 6)) for x in map(tuple, got.collect())} == want
