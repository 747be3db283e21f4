"""Clusters of integer vectors and importance resampling against brute force and SQL."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("catchment.llm")
from catchment.llm import centroids, resample
from tests.llm.conftest import TEXTS

FOLDER = "/root/testdata/sf0.001"


def by_sql(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, sorted(found.fetchall(), key=str)


def brute_clusters(vectors, size, clusters, rounds, seed):
    """(vec_id, cluster, distance, centroid digest) by comparing all with all, in Python's integers."""
    held = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in vectors if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    centres = [x for _, x in sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), x) for k, x in held if k is not None)][:clusters]
    owners = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres)) for _, x in held]
    for _ in range(rounds):
        owned = [k for _, k in owners()]
        for k in range(len(centres)):
            mine = [x for (_, x), o in zip(held, owned) if o == k]
            if mine:
                centres[k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, k, d, digest[k]) for (key, _), (d, k) in zip(held, owners())), key=str)


@pytest.mark.parametrize("spread", [1.0, 0.004, 3e6])
def test_clusters_against_brute_force(spark, spread):
    r = np.random.default_rng(7)
    points = [(k, [float(c) for c in r.normal(size=3) * spread + 5 * spread * (k % 4)]) for k in range(150)]
    odd = [(None, [1.0, 2.0, 3.0]), (200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, math.nan, 2.0]), (204, [1.0, math.inf, 2.0]), (205, [1.0, 2.0]), (206, [0.0] * 3), (206, [0.0] * 3), (206, [-1.0] * 3), (207, [-0.0] * 3)]
    rows = spark.createDataFrame([(k, v, 1, "x") for k, v in points + odd], "vec_id long, embedding array<double>, cluster int, row string").repartition(3)
    got = centroids.cluster(rows, size=3, clusters=12, rounds=6, seed=2)
    found = sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got.collect()), key=str)
    assert found == brute_clusters(points + odd, 3, 12, 6, 2)
    sums = {}
    for _, k, d, _ in found:
        sums[k] = sums.get(k, 0) + d
    most = centroids.MOST  # what a long can't hold is given as its greatest
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in got.collect()} == {(k, min(v, most), min(sum(sums.values()), most)) for k, v in sums.items()}


def test_great_components_are_exact():
    r = np.random.default_rng(2)
    x, c = r.integers(-(1 << 60), 1 << 60, (20, 4)), r.integers(-(1 << 60), 1 << 60, (5, 4))
    near, far = centroids.nearest(x, c, np.arange(5))
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)), k) for k, q in enumerate(c)) for p in x]
    assert list(zip(far, near)) == want


def test_cluster_edges(spark):
    shape = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], shape)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(None, [0.5] * 64)], shape)).count() == 0
    same = spark.createDataFrame([(k, [0.5] * 64) for k in range(90)], shape)
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in centroids.cluster(same).collect()} == {(0, 0, 0)}


def test_clusters_of_the_table(spark):
    names, want = by_sql(centroids.SQL, "embeddings")
    got = centroids.cluster(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == want


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_features(text):
    w = brute_words(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_resample(docs, target, percent, least):
    counts = [[0] * 10_000, [0] * 10_000]
    for side, texts in enumerate(([x for _, x in docs], target)):
        for text in texts:
            for b in brute_features(text):
                counts[side][b] += 1
    gain = resample.gains(*counts)
    rows = []
    for k, text in docs:
        weight, score = sum(gain[b] for b in brute_features(text)), None
        if k is not None:
            h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((k, len(brute_features(text)), weight, score, len(brute_words(text)) >= least and k is not None))
    may = sorted((-r[3], r[0]) for r in rows if r[4])
    chosen = may[: len(may) * percent // 100]
    return sorted(((k, n, w, s, chosen.index((-s, k)) + 1 if e and (-s, k) in chosen else None) for k, n, w, s, e in rows), key=str)


def test_resampling_against_brute_force(spark):
    r = np.random.default_rng(4)
    names = ["alpha", "Beta", "ÇA", "été", "42", "x_y", "d-e", "漢字", "Ω"]
    docs = [(k, " ".join(r.choice(names, r.integers(0, 40)))) for k in range(300)] + [t for t in TEXTS if t[0] != 7]
    target = ["alpha beta été 42", None, "", "漢字 Ω alpha " * 50]
    table = spark.createDataFrame([(k, x, 1, "s") for k, x in docs], "doc_id long, text string, score int, words string").repartition(5)
    wanted = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int")
    for percent in (5, 60, 0, 100):
        got = resample.resample(table, wanted, percent)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(docs, target, percent, 20)


def test_resampling_of_repeated_and_missing_rows(spark, no_docs):
    same = spark.createDataFrame([(7, "word " * 30)] * 50 + [(None, "word " * 30)] * 10, "doc_id long, text string").repartition(4)
    got = resample.resample(same, same.limit(0), 20)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 11))
    assert all(r["score"] is None and r["rank"] is None for r in got.where("doc_id is null").collect())
    assert resample.resample(no_docs, same).count() == 0


def test_resampling_of_the_table(spark):
    names, want = by_sql(resample.SQL, "documents", "benchmark")
    tables = [spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark")]
    assert sorted((tuple(r) for r in resample.resample(*tables).select(names).collect()), key=str) == want
