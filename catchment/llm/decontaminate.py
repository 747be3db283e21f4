"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``MIN_MATCH`` tokens that a text and a benchmark item share, found by a
Karp-Rabin hash that runs over the text's token numbers and is joined with the items' hashes.
Seeds on one diagonal form maximal matches; the longest match of unmarked tokens is marked again
and again, so passages count in any order and no token counts twice. An item is leaked where the
marked share of its tokens reaches ``COVERAGE``.

A benchmark of at most ``BLOCK_BYTES`` of text (counted first) is broadcast, and texts are tiled in
one scan, without a shuffle. A larger one stays a table: the texts' seeds are joined with its own,
and the pairs of texts and items whose joined seeds reach the coverage come together and are tiled.
A bitmap of the benchmark's seeds, ``BITMAP_BITS`` at most, keeps most other seeds from the join.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import map_batches, stored

MIN_MATCH, COVERAGE = 5, 0.5
BLOCK_BYTES = 16 << 20
#: Bits of the seed bitmap, at most: 64 MB.
BITMAP_BITS = 1 << 29

_TOKENS = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _TOKENS(text.lower()) if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` token numbers."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code * _BASE + ids[k : k + n].astype(np.uint64)
    return code


def tile(seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the text, length) from seeds of ``width`` tokens.

    Longest first; ties go to the first place in the item, then in the text. What a marked tile
    leaves of a shorter match is used where it still has ``width`` tokens.
    """
    runs: dict[int, list[list[int]]] = defaultdict(list)
    for p, t in sorted(seeds):
        own = runs[t - p]
        if own and own[-1][1] == p - 1:
            own[-1][1] = p
        else:
            own.append([p, p])
    heap = [(-(last - first + width), first, first + shift) for shift, own in runs.items() for first, last in own]
    heapq.heapify(heap)
    item, text, tiles = set(), set(), []
    while heap:
        size, p, t = heapq.heappop(heap)
        free = [p + k not in item and t + k not in text for k in range(-size)]
        if all(free):
            item.update(range(p, p - size))
            text.update(range(t, t - size))
            tiles.append((p, t, -size))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= width:
                    heapq.heappush(heap, (-(k - start), p + start, t + start))
                start = None
    return tiles


class Items:
    """A block of benchmark items, ready for matching. Items without a token match nothing."""

    def __init__(self, rows: list[tuple[int | None, str | None]], min_match: int = MIN_MATCH):
        self.keys = [key for key, _ in rows]
        words = [tokens(text) for _, text in rows]
        self.sizes = [len(w) for w in words]
        self.number = {w: k for k, w in enumerate(sorted({w for x in words for w in x}), 1)}
        self.ids = [np.array([self.number[w] for w in x], np.int64) for x in words]
        # Items shorter than a seed are sought whole.
        by_width = defaultdict(list)
        for k, x in enumerate(self.ids):
            width = min(min_match, len(x))
            if width:
                by_width[width] += [(int(c), k, p) for p, c in enumerate(rolling(x, width))]
        self.seeds = {}
        for width, found in by_width.items():
            places = defaultdict(list)
            for code, k, p in found:
                places[code].append((k, p))
            self.seeds[width] = np.array(sorted(places), np.uint64), places

    def leaks(self, text: str | None, coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
        """(item, marked tokens, tiles) of the items whose marked share reaches ``coverage``."""
        words = tokens(text)
        if not words or not self.number:
            return []
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        out = []
        for width, (codes, places) in self.seeds.items():
            own = rolling(ids, width)
            if not len(own):
                continue
            unknown = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(unknown[width:] == unknown[:-width])
            own = own[at]
            spot = np.searchsorted(codes, own).clip(max=len(codes) - 1)
            hit = codes[spot] == own
            seeds = defaultdict(list)
            for t, code in zip(at[hit].tolist(), own[hit].tolist()):
                for k, p in places[code]:
                    if np.array_equal(self.ids[k][p : p + width], ids[t : t + width]):
                        seeds[k].append((p, t))
            for k, pairs in seeds.items():
                reach = len({p + j for p, _ in pairs for j in range(width)})
                if reach >= coverage * self.sizes[k]:  # no tiling can mark more
                    tiles = tile(pairs, width)
                    marked = sum(n for _, _, n in tiles)
                    if marked >= coverage * self.sizes[k]:
                        out.append((k, marked, len(tiles)))
        return out


def _narrow(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def _small(benchmark: DataFrame, block_bytes: int) -> bool:
    """Whether the benchmark's text, 64 bytes a row added, has at most ``block_bytes``."""
    return (benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0) <= block_bytes


def _broadcast(benchmark: DataFrame, min_match: int):
    """Broadcast ``Items`` of a small benchmark."""
    rows = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    return benchmark.sparkSession.sparkContext.broadcast(Items(rows, min_match))


def _codes(words: list[str], width: int) -> np.ndarray:
    """A hash of every run of ``width`` words; it needs no table of word numbers."""
    return rolling(np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64), width)


def item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """item, size, width, code, place: every seed of every row of ``items`` (item, text)."""
    names = ["item", "size", "width", "code", "place"]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [[], [], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                width = min(min_match, len(words))
                codes = _codes(words, width).view(np.int64) if words else []
                for column, values in zip(columns, ([item] * len(codes), [len(words)] * len(codes), [width] * len(codes), codes, range(len(codes)))):
                    column.extend(values)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(x, pa.int64()) for x in columns[1:]]], names)

        return work

    return map_batches(items.select("item", "text"), make, "item string, size long, width long, code long, place long")


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits, 16 for each distinct code or ``BITMAP_BITS`` in all, in which the codes' last bits are set."""
    count = seeds.agg(F.approx_count_distinct("code")).first()[0]
    size = min(BITMAP_BITS, 1 << max(18, (16 * count).bit_length()))
    bits = seeds.select(F.col("code").bitwiseAND(F.lit(size - 1)).alias("spot")).selectExpr("shiftright(spot, 3) AS at", "shiftleft(1, CAST(spot & 7 AS INT)) AS bit")
    bytes_ = bits.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    # A row for each 4 KB of the bitmap.
    rows = bytes_.groupBy(F.shiftright("at", 12).alias("block")).agg(F.collect_list(F.struct("at", "bits")).alias("own")).toLocalIterator()
    bitmap = np.zeros(size // 8, np.uint8)
    for row in rows:
        at, bits = np.array(row["own"], np.int64).T
        bitmap[at] = bits
    return bitmap


def _text_seeds(texts: DataFrame, widths: list[int], bitmap) -> DataFrame:
    """key, width, code: the distinct seeds of each text whose bits are set in the bitmap."""
    names = ["key", "width", "code"]

    def make():
        bits = bitmap.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [[], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                for width in widths:
                    codes = np.unique(_codes(words, width))
                    spot = codes & np.uint64(8 * len(bits) - 1)
                    codes = codes[(bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1].view(np.int64)
                    for column, values in zip(columns, ([key] * len(codes), [width] * len(codes), codes)):
                        column.extend(values)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(x, pa.int64()) for x in columns[1:]]], names)

        return work

    return map_batches(texts.select("key", "text"), make, "key string, width long, code long")


_FOUND = "coverage double, marked long, item_tokens long, tiles long"


def _joined(texts: DataFrame, benchmark: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """key, item and what ``leaks`` tells of them: each distinct text with each distinct item it leaks.

    ``texts`` has key and text, ``benchmark`` item and text; equal keys have equal texts.
    """
    seeds = stored(item_seeds(benchmark, min_match), "seeds")
    widths = [r["width"] for r in seeds.select("width").distinct().collect()]  # at most ``min_match``
    bitmap = texts.sparkSession.sparkContext.broadcast(seed_bitmap(seeds))
    met = _text_seeds(texts, widths, bitmap).join(seeds, ["width", "code"])
    # Seeds of one item cover no more of it than all tiles can mark.
    spans = F.explode(F.sequence(F.col("place"), F.col("place") + F.col("width") - 1))
    reach = met.select("key", "item", "size", spans.alias("token")).groupBy("key", "item", "size").agg(F.count_distinct("token").alias("reach"))
    pairs = stored(reach.where(F.col("reach") >= coverage * F.col("size")).select("key", "item"), "pairs")
    both = pairs.join(texts, "key").join(benchmark.withColumnRenamed("text", "item_text"), "item").select("key", "item", "text", "item_text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for key, item, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                items = Items([(item, own)], min_match)
                rows += [(key, item, marked / items.sizes[0], marked, items.sizes[0], n) for _, marked, n in items.leaks(text, coverage)]
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "item", "coverage", "marked", "item_tokens", "tiles"])

        return work

    return map_batches(both, make, "key string, item string, " + _FOUND)


def _keyed(table: DataFrame, key: str) -> DataFrame:
    """``table`` with a key that equal texts share: a null or empty one has none."""
    return table.where("text is not null and text <> ''").withColumn(key, F.sha2("text", 256))


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, marked, item_tokens, tiles: a row for each leaked item of a document.

    Null and empty texts leak nothing, an empty benchmark gives no row; repeated rows of either
    table are each reported. Other columns are ignored.
    """
    names = ["doc_id", "item_id", "coverage", "marked", "item_tokens", "tiles"]
    docs, benchmark = _narrow(docs, "doc_id"), _narrow(benchmark, "item_id")
    if not _small(benchmark, block_bytes):
        texts, items = _keyed(docs, "key"), _keyed(benchmark, "item")
        found = _joined(texts.select("key", "text").distinct(), items.select("item", "text").distinct(), min_match, coverage)
        return found.join(texts.select("key", "doc_id"), "key").join(items.select("item", "item_id"), "item").select(names)
    held = _broadcast(benchmark, min_match)

    def make():
        items = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [
                (key, items.keys[k], marked / items.sizes[k], marked, items.sizes[k], n)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for k, marked, n in items.leaks(text, coverage)
            ]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        return work

    return map_batches(docs, make, "doc_id long, item_id long, " + _FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; all columns are kept."""
    benchmark = _narrow(benchmark, "item_id")
    if not _small(benchmark, block_bytes):
        texts, items = _keyed(docs.select(F.col(text).cast("string").alias("text")), "key"), _keyed(benchmark, "item")
        found = _joined(texts.distinct(), items.select("item", "text").distinct(), min_match, coverage)
        dirty = found.select(F.col("key").alias("_leak")).distinct()
        return docs.join(dirty, F.sha2(F.coalesce(F.col(text), F.lit("")), 256) == F.col("_leak"), "left_anti")
    held = _broadcast(benchmark, min_match)

    def make(at=docs.columns.index(text)):
        items = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([not items.leaks(x, coverage) for x in batch.column(at).to_pylist()], pa.bool_()))

        return work

    return map_batches(docs, make, docs.schema)
