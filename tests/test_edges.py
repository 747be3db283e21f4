"""Rings of channels, malformed documents, odd files, Bloom filters and drawn polygons."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.functions import documents
from catchment.operators import bloom, network, terrain
from catchment.sources import delimited


def test_channels_on_rings_stay(spark):
    rows = [(1, 2, 1.0, 1, None), (2, 1, 1.0, 1, None), (3, 1, 1.0, 1, None), (4, 3, 1.0, 1, None), (5, 5, 1.0, 1, None), (6, None, 90.0, 1, None), (7, 6, 1.0, 1, None), (8, 6, None, 1, None)]
    table = spark.createDataFrame(rows, "channel long, down long, area double, basin int, kind string")
    got = {r["channel"]: (r["target"], r["area"]) for r in network.merge_channels(table, 10.0).collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.0), 3: (3, 2.0), 4: (3, 2.0), 5: (5, 1.0), 6: (6, 91.0), 7: (6, 91.0), 8: (8, None)}


def test_malformed_documents(spark):
    rows = [(1, '{"a": 1}', '{"b": null}'), (2, "{", "{}"), (3, None, "{}"), (4, "{}", "x"), (5, "", "{}"), (6, "[1, 2]", "[2]"), (7, "null", "null")]
    table = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r["k"]: (r["p"], r["h"]) for r in table.select("k", documents.patch(F.col("a"), F.col("b")).alias("p"), documents.holds(F.col("a"), F.col("b")).alias("h")).collect()}
    assert got == {1: ('{"a":1}', False), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("[2]", True), 7: ("null", True)}
    assert {r["k"] for r in documents.tree(table, "k", "a").collect()} == {1, 4, 6, 7}
    data = spark.createDataFrame([(1, zlib.compress(b"ok")), (2, b"xx"), (3, None), (4, zlib.compress(b"\xff"))], "k int, d binary")
    assert {r["k"]: r["t"] for r in data.select("k", documents.unpack(F.col("d")).alias("t")).collect()} == {1: "ok", 2: None, 3: None, 4: None}


def test_odd_files(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    assert delimited.dialect(spark, file("a.csv", "")) == (",", False, [])
    assert delimited.dialect(spark, file("b.csv", "\n\n")) == (",", False, [])
    assert delimited.dialect(spark, file("c.csv", "12\n13\n14\n"))[0::2] == (",", ["12"])
    assert [tuple(r) for r in delimited.read_delimited(spark, file("d.csv", ""), "id int, name string").collect()] == []
    assert [r["id"] for r in delimited.read_delimited(spark, file("e.csv", "id\n12\n13\n"), "id int").collect()] == [12, 13]


def test_bloom_filters(spark):
    bits, hashes = bloom.size_for(2000, 0.01)
    words = bloom.merge(bloom.build(spark.range(1000), F.col("id"), bits, hashes), bloom.build(spark.range(1000, 2000), F.col("id"), bits, hashes))
    rows = spark.range(20_000).withColumn("id", F.when(F.col("id") < 19_999, F.col("id")))
    got = {r["id"]: r["maybe"] for r in bloom.probe(rows, F.col("id"), words, bits, hashes).collect()}
    assert all(got[k] for k in range(2000)) and got[None] is None
    assert sum(got[k] for k in range(2000, 19_999)) / 18_000 < 0.02
    none = bloom.build(spark.range(0), F.col("id"), 62, 1)
    assert none.count() == 0 and not any(r["maybe"] for r in bloom.probe(spark.range(5), F.col("id"), none, 62, 1).collect())
    with pytest.raises(ValueError):
        bloom.build(spark.range(1), F.col("id"), bloom.MOST_BITS + 1, 3)
    left = spark.range(50_000).withColumnRenamed("id", "k")
    joined = bloom.reduce_join(left, "k", spark.createDataFrame([(7,), (7,), (None,), (99_999,)], "j long"), "j")
    assert [r["k"] for r in joined.collect()] == [7]


def test_polygons_drawn_by_the_even_odd_rule(spark):
    r = np.random.default_rng(6)
    rings = [[(1.2, 0.7), (17.9, 2.2), (15.1, 14.6), (3.3, 12.0)], [(6.0, 4.0), (9.5, 4.5), (7.7, 9.25)], [tuple(p) for p in r.uniform(0, 20, (9, 2)).tolist()]]
    sides, shapes = [], [(1, rings[0]), (1, rings[1]), (2, rings[2]), (3, [(30.0, 1.0), (30.0, 2.0), (30.4, 2.0)])]
    for polygon, ring in shapes:
        sides += [(polygon, polygon * 10, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    table = spark.createDataFrame(sides + [(9, 9, None, 0.0, 1.0, 5.0)], "polygon int, value int, x1 double, y1 double, x2 double, y2 double")
    got = {(x["row"], x["col"]): x["value"] for x in terrain.rasterise(table).collect()}
    want = {}
    for row in range(25):
        for col in range(35):
            for polygon in (1, 2, 3):
                x, y = col + 0.5, row + 0.5
                crossed = sum((y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x for p, _, x1, y1, x2, y2 in sides if p == polygon)
                if crossed % 2:
                    want[(row, col)] = polygon * 10
    assert got == want and terrain.rasterise(table.limit(0)).count() == 0


def test_three_digits(spark):
    from catchment.sources import writers

    numbers = [0.0, 1.0, -1.0, 999.4, 999.6, 1000.0, 123456.0, 0.00012345, 0.000099996, 0.00001234, 12.0, 100.0, -45.678, 1e300, 2.5e-300]
    table = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x double")
    got = [(r["x"], r["t"]) for r in table.select("x", writers.three_digits(F.col("x")).alias("t")).collect()]
    assert got == [(x, f"{x:.3g}") for x in numbers] + [(None, None)]


def test_plots_need_every_month(spark):
    from catchment.sources import writers

    rows = [(2000, 11, "a", 1.0), (2000, 12, "a", 2.0), (2001, 1, "a", 1234.0), (2000, 11, "b c", 0.5), (2000, 12, "b c", 0.25), (2001, 1, "b c", 3.0), (2001, 2, "a", 9.0), (2000, 12, "z", 9.0)]
    table = spark.createDataFrame(rows, "year int, month int, label string, value double")
    got = writers.plot_table(table, ["b c", "a"], (2000, 11), (2001, 1)).orderBy("place")
    assert [tuple(r) for r in got.collect()] == [(1, "2000/11", "0.5", "1"), (2, "2000/12", "0.25", "2"), (3, "2001/1", "3", "1.23e+03")]
    with pytest.raises(ValueError, match="month 2 of 2001: b c"):
        writers.plot_table(table, ["b c", "a"], (2000, 11), (2001, 2))


def test_soil_lookup(spark):
    from catchment.operators import relational

    soils = spark.createDataFrame([(1, "m", 1, "x"), (2, "m", 2, "x"), (3, None, 1, "x"), (4, "n", 1, "y")], "soil_id int, muid string, seqn int, name string")
    layers = spark.createDataFrame([(1, 3, 0.3), (1, 1, 0.1), (2, 1, 0.2), (4, 1, 0.4), (3, 1, 0.5)], "soil_id int, layer_num int, depth double")
    look = lambda rows, option: sorted(tuple(r) for r in relational.soil_layers(spark.createDataFrame(rows, "muid string, seqn int, name string"), soils, layers, option).collect())
    assert look([("m", 1, "q"), ("m", 1, "q"), (None, 1, "x")], "stmuid+seqnum") == [("m", 1, 1, 1, 1, 0.1), ("m", 1, 1, 2, 3, 0.3)]
    assert look([("m", 9, "x")], "stmuid+name") == [("m", "x", 1, 1, 1, 0.1), ("m", "x", 1, 2, 3, 0.3), ("m", "x", 2, 1, 1, 0.2)]
    assert len(look([("m", 9, "q"), ("n", 9, "q")], "stmuid")) == 4
    with pytest.raises(ValueError):
        look([("m", 1, "x")], "other")
