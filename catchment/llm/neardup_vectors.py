"""Near-duplicate vectors through a pivot-permutation index.

Each vector is described by the ordered numbers of its nearest pivots (reference vectors). Inverted
lists, one for each label and pivot, gather the vectors that name the pivot among their ``NEAREST``;
pairs in a list that share at least ``SHARED`` pivots are candidates, and each candidate is verified
by its cosine in double precision, in the list of the smallest pivot that both name. A list longer
than a tile is split by the second pivot that a candidate of it must share, so that lists stay
short as the vectors grow in number. What is still longer than a tile, as vectors that are all
alike, is cut into tiles, and each pair of tiles is one unit of work, so no list is too long for a
task. Pairs stay inside the tasks: they give counts and spanning edges only.

How many pivots describe a vector is fitted to the data: copies of the sample's vectors, turned by the
threshold's angle, and the sample's own links tell the recall of each setting (``SETTINGS``), and of those that reach ``RECALL`` the one with
the fewest candidates is taken, the first one where it reaches it. Where none does, all vectors of a
label and length share one list, which is cut into tiles: exact, and quadratic, as in a cone so narrow
that the pivots tell nothing apart.

Pivots are drawn from a bounded sample of ``SAMPLE`` times their number and kept well apart, seen
from the sample's mean, so that vectors in a narrow cone have as many; their number grows with the
root of the vectors', up to ``MOST_PIVOTS``. Every vector is indexed. Vectors of a length that no
pivot has share one list for each label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import map_batches, stored
from catchment.llm.graph import components, local_components

COSINE = 0.98
NEAREST, SHARED = 6, 2
#: (share of the pivots, nearest ones named), the usual one first; the recall asked for; vectors that are turned; linked pairs of the sample that tell a recall.
SETTINGS = [(1, NEAREST), (1, 8), (1, 12), (1, 16), (0.25, 6), (0.25, 8), (0.25, 12), (0.0625, 6), (0.0625, 8)]
RECALL, TURNED, LEAST_NEAR = 0.99, 2048, 10
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, APART = 32, 1024, 4, 0.7
TILE = 1024


def sampled(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Unit vectors of a bounded sample, all of one length, the most frequent in it, and the number of pivots wanted."""
    count = vectors.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(2 * math.sqrt(count))))
    # A rate set by the count, so that tasks send the driver few rows in all.
    pick = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    size = max(TURNED, SAMPLE * wanted)
    rate = int(min(1.0, 1.5 * size / max(1, count)) * (1 << 30))
    rows = vectors.select("embedding", pick.alias("pick"), "rep").where(F.col("pick") < rate).orderBy("pick", "rep").limit(size).collect()
    sizes = [len(r["embedding"]) for r in rows]
    if not sizes:
        return np.empty((0, 0)), wanted
    common = max(sorted(set(sizes)), key=sizes.count)
    x = np.array([r["embedding"] for r in rows if len(r["embedding"]) == common], float)
    return x / np.linalg.norm(x, axis=1, keepdims=True), wanted


def pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` rows of the sample: seen from its mean, no two have a cosine over ``APART``."""
    if not len(sample):
        return sample
    around = sample - sample.mean(0)
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-12)
    chosen: list[int] = []
    for k in range(len(sample)):
        if len(chosen) < wanted and (not chosen or (around[chosen] @ around[k]).max() < APART):
            chosen.append(k)
    return sample[chosen]


def fitted(sample: np.ndarray, chosen: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, int, int]:
    """(pivots, nearest, shared): the setting with the fewest candidates in the sample among those with recall for turned copies; one list where there is none."""
    if not len(chosen):
        return chosen, NEAREST, SHARED
    x = sample[:TURNED]
    r = np.random.default_rng(0)
    turn = r.standard_normal(x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    copies = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * turn
    near = np.triu(x @ x.T >= cosine, 1)

    def members(rows: np.ndarray, pivot: np.ndarray, nearest: int) -> np.ndarray:
        top = np.argpartition(-(rows @ pivot.T), nearest - 1, axis=1)[:, :nearest]
        out = np.zeros((len(rows), len(pivot)), np.float32)
        np.put_along_axis(out, top, 1, 1)
        return out

    best = None
    for share, nearest in SETTINGS:
        pivot = chosen[: max(1, math.ceil(len(chosen) * share))]
        nearest = min(nearest, len(pivot))
        own, other = members(x, pivot, nearest), members(copies, pivot, nearest)
        shared = min(SHARED, nearest)
        together = own @ own.T >= shared
        turned, met = ((own * other).sum(1) >= shared).mean(), together[near].mean() if near.sum() >= LEAST_NEAR else 1.0
        if min(turned, met) >= RECALL:
            candidates = together.mean()
            if best is None or candidates < best[0]:
                best = (candidates, pivot, nearest, shared)
            if (share, nearest) == SETTINGS[0]:
                break
    return best[1:] if best else (chosen[:1], 1, 1)


def permutations(vectors: DataFrame, chosen: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """rep, label, size, times, embedding, near: the numbers of the nearest pivots, nearest first."""
    names = ["rep", "label", "size", "times", "embedding", "near"]
    held = vectors.sparkSession.sparkContext.broadcast(chosen)

    def make():
        pivot = held.value
        k = min(nearest, len(pivot))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = []
            lists = batch.column(3)
            for row in lists:
                x = np.asarray(row.values, float)
                if not k or len(x) != pivot.shape[1]:
                    near.append([-1])
                    continue
                score = pivot @ x
                top = np.argpartition(-score, k - 1)[:k]
                near.append(top[np.lexsort((top, -score[top]))].tolist())
            size = pa.array([len(x) for x in lists], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, batch.column(2), lists, pa.array(near, pa.list_(pa.int64()))], names)

        return work

    return map_batches(vectors.select("rep", "label", "times", "embedding"), make, "rep long, label int, size long, times long, embedding array<float>, near array<long>")


def _tile_links(rep: np.ndarray, times: np.ndarray, x: np.ndarray, near: np.ndarray, side: np.ndarray, pivot: int, second: int, shared: int, cosine: float):
    """(rep, links, root) of the vectors linked in one pair of tiles; side tells the tiles apart (all 0: one tile).

    Pairs that share a smaller pivot than ``pivot``, or one between it and ``second`` (-1: none), are another list's.
    """
    n, width = near.shape
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    names, local = np.unique(near, return_inverse=True)
    member = np.zeros((n, len(names)), np.float32)
    member[np.arange(n)[:, None], local.reshape(n, width)] = 1
    low = member[:, (names < pivot) | ((names > pivot) & (names < second))]
    links, u, v = np.zeros(n, np.int64), [], []
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    for k in range(0, len(a), TILE):
        own = a[k : k + TILE]
        together = (member[own] @ member[b].T >= min(shared, width)) & (low[own] @ low[b].T == 0)
        if not side.any():
            together &= own[:, None] < b
        i, j = np.nonzero(together)
        i, j = own[i], b[j]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            hit = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[hit], q[hit]
            links += np.bincount(p, times[q], n).astype(np.int64) + np.bincount(q, times[p], n).astype(np.int64)
            u.append(p)
            v.append(q)
    order = np.argsort(rep, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    root = local_components(n, rank[np.concatenate(u)], rank[np.concatenate(v)]) if u else np.arange(n)
    linked = np.flatnonzero(links)
    return rep[linked], links[linked], rep[order[root[rank[linked]]]]


def candidate_links(indexed: DataFrame, shared: int = SHARED, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """rep, links, root: from every inverted list, what it found for a vector."""
    lists = indexed.withColumn("pivot", F.explode("near"))
    # Only long lists are split, and only what is long then needs tiles; sizes come from the keys alone.
    if shared > 1:
        key = ["label", "size", "pivot"]
        long = stored(lists.groupBy(*key).count().where((F.col("count") > tile) & (F.col("pivot") >= 0)).select(*key, F.lit(True).alias("long")), "long")
        later = F.filter("near", lambda q: q > F.col("pivot"))
        lists = lists.join(long, key, "left").withColumn("next", F.explode(F.when(F.col("long"), later).otherwise(F.array(F.lit(-1).cast("long")))))
    else:
        lists = lists.withColumn("next", F.lit(-1).cast("long"))
    keys = ["label", "size", "pivot", "next"]
    tiled = stored(lists.groupBy(*keys).count().where(F.col("count") > tile).select(*keys, F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "tiles")
    rows = lists.join(tiled, keys, "left")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    rows = rows.select(*keys, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "times", "embedding", "near")
    unit = [*keys, "first", "second"]
    names = ["rep", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done():
            part = [np.concatenate(x) for x in zip(*held)]
            found = _tile_links(part[0], part[1], part[2], part[3], part[4], key[2], key[3], shared, cosine)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            code = np.stack([column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in unit], 1)
            starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]).any(1)))
            for s, e in zip(starts, np.append(starts[1:], len(code))):
                if tuple(code[s]) != key:
                    if held and sum(len(h[0]) for h in held) > 1:
                        yield done()
                    held, key = [], tuple(code[s])
                part = {c: column[c].slice(s, e - s) for c in ("rep", "times", "embedding", "near", "side")}
                wide = lambda c: np.asarray(part[c].flatten()).reshape(e - s, -1)
                held.append((np.asarray(part["rep"]), np.asarray(part["times"]), wide("embedding").astype(float), wide("near"), np.asarray(part["side"])))
        if held and sum(len(h[0]) for h in held) > 1:
            yield done()

    dealt = rows.repartition(*unit).sortWithinPartitions(*unit).select(*unit, "side", "rep", "times", "embedding", "near")
    return dealt.mapInArrow(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine is at least ``cosine``.
    Null and zero vectors, those with null or non-finite components, and rows without vec_id link
    with nothing. Equal vectors are compared once and counted as often as they occur; rows that
    repeat a vec_id count as vectors of their own. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    distinct = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    distinct = stored(distinct, "vectors")
    sample, wanted = sampled(distinct)
    pivot, nearest, shared = fitted(sample, pivots(sample, wanted), cosine)
    indexed = stored(permutations(distinct, pivot, nearest), "permutations")
    found = stored(candidate_links(indexed, shared, cosine, TILE), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = distinct.select("label", "embedding", "rep", "times").join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "embedding", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    single = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("good").join(named, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.col("vec_id") == F.col("component_id"))
