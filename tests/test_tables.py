"""Stored tables, delimited files, decision tables, report rules, sequences and chosen groups: edge cases and brute force."""

import itertools
import json
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catchment.functions import documents
from catchment.operators import aggregates, calibration, model_rules, network, sampling, stored
from catchment.sources import delimited


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def written(folder, name, text):
    path = folder / name
    path.write_text(text)
    return f"file://{path}"


def test_stored_tables(spark):
    name = stored.create(spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id int, s string"), stored.fresh_name("t"))
    with pytest.raises(Exception):
        stored.create(spark.range(1), name)
    assert values(stored.insert(spark, name, spark.createDataFrame([("7", 1)], "id string, other int"))) == [(7, None)]
    stored.insert_values(spark, name, ["x", "y"])
    stored.update(spark, name, F.col("id") > 1, s="big")
    stored.update_ids(spark, name, "id", spark.createDataFrame([(1,), (1,), (99,)], "k int"), s="one")
    assert values(spark.table(name)) == sorted([(1, "one"), (2, "big"), (7, "big"), (None, "c"), (None, "y")], key=str)
    stored.delete(spark, name, F.col("id") == 2)
    assert spark.table(name).count() == 4
    stored.delete(spark, name)
    assert spark.table(name).count() == 0 and spark.catalog.tableExists(name)
    assert values(stored.columns(spark, name), "name", "type") == [("id", "int"), ("s", "string")]
    assert values(stored.tables(spark, name)) == [(name,)]
    new = stored.fresh_name("u")
    stored.rename(spark, name, new)
    assert spark.catalog.tableExists(new) and not spark.catalog.tableExists(name)
    stored.drop(spark, new)
    stored.drop(spark, new)
    assert not spark.catalog.tableExists(new)


def test_names_and_order_of_tables(spark):
    files = spark.createDataFrame([(1, "My_Soil"), (2, "x"), (3, "y"), (4, "z"), (5, "My_Soil"), (6, None)], "file int, stem string")
    assert values(stored.new_names(files, "soil")) == [(1, "My_Soil"), (2, "soil_lookup"), (3, "soil_lookup0"), (4, "soil_lookup1"), (5, "My_Soil0"), (6, "soil_lookup2")]
    keys = spark.createDataFrame([("c", "b"), ("c", "a"), ("b", "a"), ("x", "y"), ("y", "x"), ("lone", None)], "name string, parent string")
    order = [r["name"] for r in stored.in_order(keys).orderBy("place").collect()]
    assert order == ["a", "lone", "b", "c", "x", "y"]
    assert stored.in_order(keys.limit(0)).count() == 0


def test_delimited_files(spark, tmp_path):
    semi = written(tmp_path, "a.csv", "id;name;x\n1;One;2,5\n2;TWO;null\n3;three;1,2,3\n")
    assert delimited.dialect(spark, semi) == (";", True, ["id", "name", "x"])
    assert values(delimited.read_delimited(spark, semi, "id int, name string, x double", lower_names=True)) == [(1, "one", 2.5), (2, "two", None), (3, "three", None)]
    assert values(delimited.read_delimited(spark, semi, "id int")) == [(1,), (2,), (3,)]
    with pytest.raises(Exception):
        delimited.read_delimited(spark, written(tmp_path, "b.csv", "1,2,3\n4,5\n"), "a int, b int, c int", header=False).collect()
    plain = written(tmp_path, "c.txt", "title\nhead\n  1   a  9\n\n2 null 8\n")
    assert values(delimited.read_lines(spark, plain, "id int, name string")) == [(1, "a"), (2, None)]
    with pytest.raises(Exception):
        delimited.read_lines(spark, plain, "a int, b string, c int, d int").collect()
    two, three = written(tmp_path, "d.csv", "LANDUSE_ID,CODE\n1,AGRL\n"), written(tmp_path, "e.csv", "1\tAGRL\tfields\n2\tFRST\twoods\n")
    assert values(delimited.import_kind(spark, two, "landuse")) == [(1, "AGRL")]
    assert values(delimited.import_kind(spark, three, "landuse")) == [(1, "AGRL", "fields"), (2, "FRST", "woods")]


def test_rows_whose_names_are_taken(spark):
    table = spark.createDataFrame([("a", 1), ("a1", 2), ("a3", 3), ("b1", 4), ("a01", 5), (None, 6)], "name string, x int")
    rows = spark.createDataFrame([("a", 10), ("a", 11), ("b", 12), ("a1", 13), (None, 14)], "name string, x int")
    added = sorted([("a2", 10), ("a2", 11), ("b", 12), ("a11", 13), (None, 14)], key=str)
    assert values(delimited.add_rows(table, rows, "rename").where("x > 9")) == added
    assert values(delimited.add_rows(table, rows, "replace")) == sorted([("a", 11), ("a1", 13), ("a3", 3), ("b1", 4), ("a01", 5), (None, 6), ("b", 12), (None, 14)], key=str)
    assert delimited.add_rows(table, rows).count() == 11 and delimited.add_rows(table.limit(0), rows, "rename").count() == 5
    with pytest.raises(ValueError):
        delimited.add_rows(table, rows, "other")


def test_strict_and_widening_imports(spark, tmp_path):
    table = spark.createDataFrame([(1, 1.5)], "id int, x double")
    path = written(tmp_path, "a.json", json.dumps({"id": 2, "more": "m"}) + "\n")
    assert values(delimited.import_format(spark, path, "json", table, True)) == [(1, 1.5), (2, None)]
    assert values(delimited.import_format(spark, path, "json", table)) == [(1, 1.5, None), (2, None, "m")]
    with pytest.raises(ValueError):
        delimited.import_format(spark, path, "xml", table)


def test_decision_tables(spark):
    text = ["d.dtl", "2", "", "name conds alts acts !about it", "one 1 2 2", "var obj obj_num lim_var lim_op lim_const alt1 alt2", "w hru 0 null - 1.5 > < !why", "act_typ obj obj_num name option const const2 fp outcome", "plow hru 0 a b 1.0 2.0 null y n", "rest hru 1 a b 1.0 2.0 null n", "", "",
            "name conds alts acts", "two 0 0 1", "var obj", "act_typ obj", "sow hru 0 a b c d e"]
    lines = spark.createDataFrame([(p, k, x) for p in ("f", "g") for k, x in enumerate(text, 1)], "path string, line int, value string")
    conds, alts, acts = delimited.decision_tables(lines)
    assert values(conds, "path", "table", "var", "lim_const") == [("f", "one", "w", 1.5), ("g", "one", "w", 1.5)]
    assert values(alts.where("path = 'f'"), "cond", "alt", "value") == [(1, 1, ">"), (1, 2, "<")]
    assert values(acts.where("path = 'g'"), "table", "act", "act_typ", "outcomes") == [("one", 1, "plow", [True, False]), ("one", 2, "rest", [False]), ("two", 1, "sow", [])]
    assert all(x.count() == 0 for x in delimited.decision_tables(lines.limit(0)))


def test_report_rules_of_odd_rows(spark):
    columns = "landuse string, area double, cn double, irr double, prec double, surq double, et double, sed double, no3 double, orgn double, biom double, yld double"
    rows = [("a ", 1.0, 96.0, 0.0, 100.0, 60.0, 10.0, 0.0, 81.0, 0.0, 60000.0, 0.0), ("a", 3.0, 96.0, 0.0, 100.0, 60.0, 10.0, 0.0, 81.0, 0.0, 60000.0, 0.0), (None, 0.0, 1.0, *[0.0] * 9), ("n", *[None] * 11)]
    got = {r["landuse"]: (r["area"], r["warnings"]) for r in model_rules.land_use(spark.createDataFrame(rows, columns)).collect()}
    assert got["a"][0] == 4 and "a nitrate yield may be too high 81.00 kg/ha" in got["a"][1] and "a biomass may be too high 60.00 t/ha" in got["a"][1] and "a ET less than 31% of irrigation water + precipitation" in got["a"][1]
    assert got["NA"][0] == 0 and "NA curve number may be too low" in got["NA"][1] and got["n"][0] == 0
    assert model_rules.land_use(spark.createDataFrame([], columns)).count() == 0
    loads = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 9.0, 1.0)], "sub_flow double, sub_sed double, sub_n double, sub_p double, ps_flow double, ps_sed double, ps_n double, ps_p double")
    got = sorted(len(r["warnings"]) for r in model_rules.point_sources(loads).collect())
    assert got == [1, 6]
    names = "name string, sed_in double, sed_out double, n_in double, n_out double, p_in double, p_out double, stor double, seep double, evap double"
    each, every = model_rules.reservoirs(spark.createDataFrame([("r", 0.0, 0.0, 10.0, 1.0, 10.0, 5.0, 0.0, 1.0, 1.0), ("s", None, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], names), spark.createDataFrame([("r", 1, 1.0), ("r", 2, 9.0)], "name string, yr int, stor double"))
    assert {r["name"]: (r["volume_ratio"], r["fraction_empty"]) for r in each.collect()} == {"r": (9.0, 0.0), "s": (0.0, 0.0)}
    assert every.first()["most"] == 9.0 and any("500%" in x for x in every.first()["warnings"])
    none = model_rules.reservoirs(spark.createDataFrame([], names), spark.createDataFrame([], "name string, yr int, stor double"))
    assert none[0].count() == 0 and none[1].first()["n"] == 0 and none[1].first()["warnings"] == []
    basin = spark.createDataFrame([(1.0, 1.0, *[0.0] * 10), (1.0, 9.0, 1.0, 9.0, 1.0, 0.1, 2.0, 1.0, 1.0, 0.0, 1.0, 1.0)], "sed_in double, sed_out double, n_in double, n_out double, p_in double, p_out double, upland_sed double, load_n double, load_p double, yield double, tloss double, tevap double")
    got = [r["warnings"] for r in model_rules.instream(basin).collect()]
    assert got[0] == [model_rules.INSTREAM[2][3]] and len(got[1]) == 4


def test_sobol_dimensions_are_balanced(spark):
    """In every dimension the first 2^k points lie one in each of 2^k equal parts; no two dimensions are the same."""
    table = spark.range(64).select("id", *[sampling.sobol(F.col("id"), k).alias(f"u{k}") for k in range(40)]).orderBy("id").toPandas()
    for k in range(40):
        u = table[f"u{k}"].to_numpy()
        assert all(sorted((u[:n] * n).astype(int).tolist()) == list(range(n)) for n in (2, 8, 64))
    assert len({tuple(table[f"u{k}"]) for k in range(40)}) == 40
    assert table["u0"][:5].tolist() == [0.0, 0.5, 0.75, 0.25, 0.375]
    with pytest.raises(ValueError):
        sampling.sobol_sample(spark, 1, [("p", 0.0, 1.0)] * 41)


def test_generator(spark):
    seed = 12345
    got = spark.createDataFrame([(seed,)], "s long").select(sampling.next_seed(F.col("s")).alias("n"), sampling.uniform_integer(-100, 200, F.col("s")).alias("v")).first()
    assert got["n"] == seed * 16807 % (2**31 - 1) and -100 <= got["v"] <= 200


def test_chosen_group_against_brute_force(spark):
    walks = calibration.morris(spark, [("a", 0.0, 1.0), ("b", 0.0, 1.0), ("c", 0.0, 1.0)], 14, seed=3)
    points = walks.groupBy("run", "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda x: x["value"]).alias("x"))
    own = {}
    for r in points.orderBy("run", "step").collect():
        own.setdefault(r["run"], []).append(r["x"])
    shapes = {}
    for run, p in own.items():
        shapes.setdefault(str(sorted(p)), run)
    runs = sorted(shapes.values())
    dist = {(a, b): round(float(sum(np.linalg.norm(np.subtract(p, q)) for p in own[a] for q in own[b])), 9) for a, b in itertools.permutations(runs, 2)}
    best = None
    for m in runs:
        group, total = [m], 0.0
        while len(group) < 4:
            far = {j: round(sum(dist[k, j] ** 2 for k in group) ** 0.5, 6) for j in runs if j not in group}
            pick = max(far, key=lambda j: (far[j], -j))
            group.append(pick)
            total += far[pick]
        if best is None or round(total, 4) > best[0]:
            best = round(total, 4), group
    got = [r["run"] for r in calibration.spread_group(points, 4).orderBy("place").collect()]
    assert got == best[1]


def test_channel_merges(spark):
    """A small channel goes into a large one; water holds its channel; a lake takes none; merges go on as areas grow."""
    rows = [(1, None, 50.0, 1, None), (2, 1, 5.0, 1, None), (3, 2, 5.0, 1, None), (4, 1, 5.0, 1, "water"), (5, 1, 80.0, 1, None), (6, 7, 1.0, 1, None), (7, None, 1.0, 1, "lake"), (8, 1, 1.0, 2, None), (9, 5, 90.0, 1, None)]
    table = spark.createDataFrame(rows, "channel long, down long, area double, basin int, kind string")
    got = {r["channel"]: (r["target"], r["area"]) for r in network.merge_channels(table, 10.0).collect()}
    assert got == {1: (1, 60.0), 2: (1, 60.0), 3: (1, 60.0), 4: (4, 5.0), 5: (5, 80.0), 6: (6, 1.0), 7: (7, 1.0), 8: (8, 1.0), 9: (9, 90.0)}
    assert network.merge_channels(table.limit(0), 10.0).count() == 0


def test_labels_and_prefixes(spark):
    cells = spark.createDataFrame([(1, None, "r1", True), (2, 1, None, True), (3, 2, None, True), (4, 2, None, False), (5, 4, None, True), (6, 3, "r6", False), (7, 6, None, True), (8, None, None, True)], "node long, down long, label string, flooded boolean")
    assert values(network.spread_labels(cells)) == [(1, "r1"), (2, "r1"), (3, "r1"), (6, "r6"), (7, "r6")]
    table = spark.createDataFrame([([1, 2, 3], [1, 2, 9, 9]), ([1], [1, 2]), ([], [1]), ([2], [3]), ([1, None], [1, None, 5])], "a array<int>, b array<int>")
    assert [tuple(map(list, r)) for r in table.select(*network.without_common_prefix(F.col("a"), F.col("b"))).collect()] == [([3], [9, 9]), ([], [2]), ([], [1]), ([2], [3]), ([], [5])]


def test_json_operators(spark):
    table = spark.createDataFrame([('{"a": {"b c": [1, "x"]}, "z": null}',), ("[1]",), ("no json",), (None,)], "d string")
    got = table.select(documents.at_path(F.col("d"), "a", "b c").alias("p"), documents.text_at(F.col("d"), "a", "b c", 1).alias("t"), documents.has_keys(F.col("d"), ["a", "z"]).alias("every"), documents.has_keys(F.col("d"), ["q", "z"], every=False).alias("any")).collect()
    assert [tuple(r) for r in got] == [('[1,"x"]', "x", True, True), (None, None, False, False), (None, None, False, False), (None, None, None, None)]
    same = spark.createDataFrame([('{"a":1,"b":[2]}', ' { "b" : [2], "a" : 1 } '), ("{}", "[]"), (None, "{}")], "a string, b string").select(documents.same_document(F.col("a"), F.col("b")).alias("s"))
    assert [r["s"] for r in same.collect()] == [True, False, None]


def test_queries_that_sql_cannot_express(spark):
    folder, queries = "/root/testdata/sf0.001", entry.queries()
    names = {r["p_partkey"]: r["p_name"].encode() for r in spark.read.parquet(f"{folder}/part.parquet").collect()}
    for r in queries["fn_50"](spark, folder).collect():
        assert r["c"] == zlib.crc32(names[r["p_partkey"]]) and r["x"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(names[r["p_partkey"]], 42)
    for name in ("fn_9", "fn_10", "sa_2", "sa_14", "sa_15"):
        a, b = values(queries[name](spark, folder)), values(queries[name](spark, folder).repartition(3))
        assert a == b
    x = np.array([r["x"] for r in queries["sa_14"](spark, folder).collect()])
    assert abs(x.mean() - 3) < 0.15 and abs(x.std() - 2) < 0.15
    logs = np.log([r["x"] for r in queries["sa_15"](spark, folder).collect()])
    assert abs(logs.mean() - 1) < 0.05 and abs(logs.std() - 0.5) < 0.05


def test_exact_percentiles(spark):
    r = np.random.default_rng(1)
    rows = [(str(k % 3) if k % 3 else None, float(x)) for k, x in enumerate(r.integers(0, 40, 700))] + [("lone", 5.0), ("none", None), ("0", None)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.85, "e": 1.0}
    got = {r["g"]: [r[n] for n in shares] for r in aggregates.exact_percentiles(table, ["g"], "x", shares).collect()}
    groups = {g: [x for h, x in rows if h == g and x is not None] for g in {g for g, _ in rows}}
    assert got == {g: pytest.approx(np.quantile(x, list(shares.values())).tolist()) for g, x in groups.items() if x}
    assert aggregates.exact_percentiles(table, [], "x", {"m": 0.5}).first()["m"] == np.median([x for _, x in rows if x is not None])
    assert aggregates.exact_percentiles(table.limit(0), ["g"], "x", shares).count() == 0


def test_one_round_of_evolution(spark):
    rows = entry.queries()["sa_29"](spark, "/root/testdata/sf0.001").collect()
    start = [(-2 + k % 5, -2 + k // 5) for k in range(20)]
    rosenbrock = lambda x, y: 100 * (y - x * x) ** 2 + (1 - x) ** 2
    old = sorted(start, key=lambda p: rosenbrock(*p))
    assert len(rows) == 20 and all(r["score"] == pytest.approx(rosenbrock(r["x"], r["y"])) and max(abs(r["x"]), abs(r["y"])) <= 2 for r in rows)
    changed = [r["k"] for r in rows if (r["x"], r["y"]) not in start]
    assert 0 < len(changed) <= 4 and sum((r["x"], r["y"]) in start for r in rows) >= 16 and old[0] in [(r["x"], r["y"]) for r in rows]
