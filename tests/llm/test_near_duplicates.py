"""SimHash groups, vector groups and components against brute force."""

import re

import numpy as np
import pytest

pytest.importorskip("catchment.llm")
import xxhash

from catchment.llm import graph, neardup_vectors, simhash
from tests.llm.conftest import TEXTS


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(codes, distance=3):
    codes = np.array(codes, np.uint64)
    u, v = np.triu_indices(len(codes), 1)
    hit = np.bitwise_count(codes[u] ^ codes[v]) <= distance
    return graph.local_components(len(codes), u[hit], v[hit])


def test_fingerprints():
    for _, x in TEXTS:
        if x is None or len(x) < 1000:
            assert simhash.fingerprint(x.encode() if x is not None else None) == brute_fingerprint(x)


@pytest.mark.parametrize("crowded", [1 << 15, 8])
def test_groups_against_brute_force(spark, crowded):
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    codes = centres[r.integers(0, 4, 500)]
    for _ in range(5):
        codes = codes ^ (np.uint64(1) << r.integers(0, 40, 500).astype(np.uint64))
    codes = np.unique(codes)
    table = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.near_edges(table, crowded)).collect()}
    got = [roots.get(int(x), int(x)) for x in codes.view(np.int64)]
    want = brute_groups(codes)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want.tolist()))) == len(set(got))


def test_index_prunes_nothing_linked():
    r = np.random.default_rng(5)
    for spread in (3, 6, 12):
        codes = np.repeat(r.integers(0, 1 << 63, 3, dtype=np.uint64), 400)
        for _ in range(spread):
            codes = codes ^ (np.uint64(1) << r.integers(0, 64, len(codes)).astype(np.uint64))
        codes = np.unique(codes)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        u, v = simhash.bucket_links(codes)
        assert (np.bitwise_count(codes[u] ^ codes[v]) <= 3).all()
        assert (graph.local_components(len(codes), u, v) == brute_groups(codes)).all()


def test_odd_documents(spark, odd_docs, no_docs):
    got = sorted(((r["doc_id"] or 0), r["fp"], r["component_id"]) for r in simhash.simhash_groups(odd_docs).collect())
    assert len(got) == len(TEXTS)
    zero = {k: c for k, fp, c in got if fp == 0}
    assert zero == {1: 1, 2: 1, 3: 1}
    assert simhash.simhash_groups(no_docs).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    codes = [brute_fingerprint(x) for _, x in rows]
    label = brute_groups(codes)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert got == {k: (c, rows[label[n]][0]) for n, ((k, _), c) in enumerate(zip(rows, codes))}


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)] + [(1000, k) for k in range(900, 990)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    a, b = np.array(edges).T
    want = graph.local_components(1001, a, b)
    assert got == {n: int(want[n]) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.components(spark.createDataFrame([(None, 1), (2, None), (None, None)], "a long, b long")).count() == 0


def brute_vectors(rows):
    out = {}
    good = [(k, np.asarray(v, float), l) for k, v, l in rows if k is not None and v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(np.asarray(v, float))]
    n, u, v = len(good), [], []
    for a in range(n):
        for b in range(a + 1, n):
            x, y = good[a][1], good[b][1]
            if good[a][2] == good[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                u.append(a)
                v.append(b)
    label = graph.local_components(n, np.array(u, int), np.array(v, int))
    links = np.bincount(np.array(u + v, int), minlength=n)
    names = np.array([k for k, *_ in good])
    for c in set(label.tolist()):
        least = int(names[label == c].min())
        for k in np.flatnonzero(label == c):
            out[int(names[k])] = (int(links[k]), least)
    return out


@pytest.mark.parametrize("centre, width, least", [(0.0, 48, 0.97), (4.0, 48, 0.95), (5.0, 64, 0.95), (6.0, 64, 0.95), (6.0, 256, 0.95)])
def test_recall_of_pairs_near_the_threshold(spark, centre, width, least):
    """Planted pairs of cosine 0.98 to 0.985, in all directions and in cones of mean cosine 0.94 to 0.974; long lists are split."""
    r = np.random.default_rng(8)
    n = 3000 if width < 64 else 1200
    base = r.standard_normal((n, width))
    base[:, 0] += centre * width**0.5
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = r.standard_normal((n, width))
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = r.uniform(0.9801, 0.985, (n, 1))
    pairs = cosine * base + np.sqrt(1 - cosine**2) * turn
    data = np.concatenate([base, pairs]).astype(np.float32)
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(data)], "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x["n_links"] for x in neardup_vectors.near_vectors(table).collect()}
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    assert want.sum() >= 2 * n and all(got[k] <= want[k] for k in range(2 * n))
    assert sum(got.values()) / want.sum() > least
    assert sum(got[k] == 0 for k in range(2 * n)) <= 0.02 * 2 * n


def test_fitted_settings_reach_their_recall():
    """Cones with a mean cosine of up to 0.9995; vectors in all directions keep the usual setting."""
    r = np.random.default_rng(1)
    for centre in (0.0, 6.0, 40.0):
        x = r.standard_normal((600, 32))
        x[:, 0] += centre * 32**0.5
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pivot, nearest, shared = neardup_vectors.fitted(x, neardup_vectors.pivots(x, 100))
        assert centre or (nearest, shared) == (neardup_vectors.NEAREST, neardup_vectors.SHARED)
        named = [set(np.argsort(-(pivot @ v), kind="stable")[:nearest]) for v in x]
        a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        assert not len(a) or np.mean([len(named[i] & named[j]) >= shared for i, j in zip(a, b)]) > 0.98


@pytest.mark.parametrize("tile", [1024, 16])
def test_vectors_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "TILE", tile)
    r = np.random.default_rng(2)
    base = r.standard_normal((30, 16))
    data = np.concatenate([r.standard_normal((60, 16)), np.repeat(base[:4], 20, 0) + 0.03 * r.standard_normal((80, 16)), base[4:6], base[4:6], base[4:5]]).astype(np.float32)
    rows = [(1000 - k, [float(x) for x in v], k % 3 if k < 60 else 1) for k, v in enumerate(data)]
    rows += [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] + [1.0] * 15, 1), (4, [float("inf")] * 16, 1), (5, rows[-1][1], None), (6, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (8, [], 1)]
    table = spark.createDataFrame([(*x, "n_links", 1) for x in rows], "vec_id long, embedding array<float>, label int, component_id string, rep int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in neardup_vectors.near_vectors(table).collect()}
    want = brute_vectors(rows)
    assert len(got) == len(rows) and all(got[k] == (0, k) for k in (1, 2, 3, 4, 5, 8))
    assert {k: v for k, v in got.items() if k in want} == want


def test_no_vectors(spark):
    assert neardup_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
