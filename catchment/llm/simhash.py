"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree in at least three of six blocks of bits. For
each of the twenty choices of three blocks, the fingerprints that share the masked pattern form a
bucket; a crowded bucket is masked once more inside its free bits, after which it has 2^17
fingerprints at most, by construction. Inside a bucket the fingerprints are sorted by Gray rank,
neighbours are gathered in nodes that keep the bits their members share, and nodes in upper nodes.
A pair of nodes is dropped with all below it once the differences in shared bits pass the bound, or
once both sides are known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import map_batches, stored
from catchment.llm.graph import components, local_components

#: Bits that linked fingerprints may differ in.
DISTANCE = 3
BLOCKS = 6
#: Fingerprints of a bucket beyond which it is masked again.
CROWDED = 1 << 15
#: Members of a node, and the bucket size from which the index is built.
NODE, SMALL = 16, 48
#: Node pairs handled at a time.
FRONTIER = 1 << 18


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the whole text's word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return sum(1 << k for k in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(x, width, seed) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

        return work

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(narrow, make, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in Gray order."""
    rank = fp.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def bucket_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of linked fingerprints in one bucket; they connect all that is connected there.

    ``fp`` is in Gray order, without repeats.
    """
    n = len(fp)
    u, v = [], []
    for step in range(1, min(n, NODE)):  # neighbours in Gray order first: they connect most of a tight group
        hit = np.flatnonzero(_near(fp[:-step], fp[step:]))
        u.append(hit)
        v.append(hit + step)
    label = local_components(n, np.concatenate(u), np.concatenate(v)) if u else np.arange(n)
    # Levels: the codes themselves, then nodes: shared bits, which they are, and the component if there is one.
    value, mask, group = fp, np.full(n, ~np.uint64(0)), label
    levels = [(value, mask, group)]
    while len(value) > NODE:
        pad = -len(value) % NODE
        value, mask, group = (np.append(x, np.repeat(x[-1:], pad)).reshape(-1, NODE) for x in (value, mask, group))
        first = value[:, :1]
        mask = np.bitwise_and.reduce(mask & ~(value ^ first), axis=1)
        value = value[:, 0] & mask
        group = np.where((group == group[:, :1]).all(1), group[:, 0], -1)
        levels.append((value, mask, group))
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    todo = [(top, a, b, np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint64))]
    while todo:
        level, a, b, differ, known = todo.pop()
        if len(a) > FRONTIER:
            for k in range(0, len(a), FRONTIER):
                todo.append((level, *(x[k : k + FRONTIER] for x in (a, b, differ, known))))
            continue
        value, mask, group = levels[level]
        shared = mask[a] & mask[b]
        differ = differ + np.bitwise_count((value[a] ^ value[b]) & shared & ~known)  # what this level adds
        if level == 0:
            hit = (differ <= DISTANCE) & (label[a] != label[b])
            u.append(a[hit])
            v.append(b[hit])
            continue
        live = (differ <= DISTANCE) & ~((group[a] >= 0) & (group[a] == group[b]))
        a, b, differ, shared = a[live], b[live], differ[live], shared[live]
        if len(a):
            size = len(levels[level - 1][0])
            grid = np.arange(NODE)
            a2 = (a[:, None, None] * NODE + grid[None, :, None]).repeat(NODE, 2).ravel()
            b2 = (b[:, None, None] * NODE + grid[None, None, :]).repeat(NODE, 1).ravel()
            keep = (a2 < size) & (b2 < size) & (a2 <= b2)
            for k in range(0, len(a2), FRONTIER):
                at = np.flatnonzero(keep[k : k + FRONTIER]) + k
                up = at // (NODE * NODE)
                todo.append((level - 1, a2[at], b2[at], differ[up], shared[up]))
    return np.concatenate(u), np.concatenate(v)


def forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint connected) for those linked to another of the same key.

    Rows are sorted by key, then Gray rank.
    """
    if len(fp) < 2:
        return fp[:0], fp[:0]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    size = np.repeat(sizes, sizes)
    after = np.repeat(starts + sizes, sizes) - np.arange(len(key))  # rows of the key from here on
    u, v = [], []
    at = np.flatnonzero((size > 1) & (size <= SMALL))
    step = 1
    while len(at := at[after[at] > step]):
        hit = at[_near(fp[at], fp[at + step])]
        u.append(hit)
        v.append(hit + step)
        step += 1
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        a, b = bucket_links(fp[s : s + n])
        u.append(a + s)
        v.append(b + s)
    if not u:
        return fp[:0], fp[:0]
    codes, place = np.unique(fp, return_inverse=True)
    label = local_components(len(codes), place[np.concatenate(u)], place[np.concatenate(v)])
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def _bits(start: int, width: int) -> int:
    return ((1 << width) - 1) << start


def _masks(free: int, parts: int, kept: int) -> list[int]:
    """Masks that keep ``kept`` of ``parts`` runs of the free bits, and all others."""
    places = [k for k in range(64) if free >> k & 1]
    runs = [sum(1 << k for k in part.tolist()) for part in np.array_split(places, parts)]
    return [sum(x) | (~free & (1 << 64) - 1) for x in combinations(runs, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masked(masks: list[int], fp: Column) -> Column:
    """Array of (mask number, masked pattern)."""
    return F.array(*[F.struct(F.lit(k).alias("mask"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("pattern")) for k, m in enumerate(masks)])


def _gray(fp: Column) -> Column:
    rank = fp
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # so that signed order is unsigned order


def _bucket_edges(rows: DataFrame) -> DataFrame:
    """a, b for rows (key..., fp), dealt by all columns but fp."""
    keys = [c for c in rows.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            key, fp = (np.concatenate(x) for x in zip(*held))
            a, b = forest(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(keys))]
            key = np.stack(columns, 1).view(np.dtype([(k, np.int64) for k in keys])).ravel()
            fp = batch.column(len(keys)).to_numpy(zero_copy_only=False).view(np.uint64)
            # Whole buckets only: what follows the last change of key waits for the next batch.
            if held and held[-1][0][-1] != key[0] and sum(len(x[0]) for x in held) >= 1 << 16:
                yield flush()
                held = []
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(change) and sum(len(x[0]) for x in held) + len(key) >= 1 << 16:
                cut = change[-1] + 1
                held.append((key[:cut], fp[:cut]))
                yield flush()
                held = [(key[cut:], fp[cut:])]
            else:
                held.append((key, fp))
        if held:
            yield flush()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, _gray(F.col("fp")))
    return dealt.select(*keys, "fp").mapInArrow(run, "a long, b long")


def near_edges(codes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a, b: edges that connect the distinct fingerprints ``codes`` (fp) at three bits or fewer."""
    masks = _masks((1 << 64) - 1, BLOCKS, BLOCKS - DISTANCE)
    rows = codes.select(F.explode(_masked(masks, F.col("fp"))).alias("m"), "fp").select("m.mask", "m.pattern", "fp")
    full = stored(rows.groupBy("mask", "pattern").count().where(F.col("count") > crowded).select("mask", "pattern"), "crowded")
    if full.isEmpty():
        return _bucket_edges(rows)
    plain = rows.join(full, ["mask", "pattern"], "left_anti")
    dense = rows.join(full, ["mask", "pattern"], "left_semi")
    parts = []
    for k, m in enumerate(masks):
        inner = _masks(~m & (1 << 64) - 1, BLOCKS, BLOCKS - DISTANCE)
        parts.append(F.when(F.col("mask") == k, _masked(inner, F.col("fp"))))
    again = dense.select("mask", F.explode(F.coalesce(*parts)).alias("m"), "fp")
    again = again.select("mask", F.col("m.mask").alias("inner"), F.col("m.pattern").alias("pattern"), "fp")
    return _bucket_edges(plain).unionByName(_bucket_edges(again))


def simhash_groups(docs: DataFrame, width: int = 3, seed: int = 42, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the smallest doc_id of the group.

    Null and empty texts have fingerprint zero, which is linked like any other. Rows with a null
    doc_id take part; the smallest doc_id ignores them (null if a group has none). Repeated rows
    are kept. Other columns are ignored.
    """
    codes = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(codes.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "codes")
    roots = stored(components(near_edges(distinct.select("fp"), crowded)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return codes.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
