"""Token ids in one compressed wavelet-matrix file per shard, and reading them back.

A wavelet matrix keeps the k-th highest bit of every id in the k-th bit plane; each plane orders the
ids stably by the bit before. Rank and select on the planes give the id at a place, the count of an
id before a place and the place of its j-th occurrence without decoding the shard. A file holds the
documents' keys and lengths, then the planes in compressed blocks, each with the count of ones
before it, so that a look-up inflates one block of each plane.

File: magic, length of the header and the JSON header (little-endian), document directory (zlib), blocks.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchment.llm.bpe import tokenizer
from catchment.llm.common import filesystem, new_folder, stored

MAGIC = b"WVMX0001"
#: Bits of a block of a plane.
BLOCK_BITS = 1 << 18
#: Ids after which a shard is closed; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 22
#: Tasks of the reading stage, at most.
MOST_TASKS = 20_000


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int = 16) -> bytes:
    """The file of a shard: documents in order, ``ids`` the concatenation of their ids."""
    directory = zlib.compress(np.asarray([[d is not None, d or 0, n] for d, n in zip(doc_ids, lengths)], "<i8").reshape(-1, 3).T.tobytes(), 1)
    planes, blobs, at = [], [], 0
    values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    step = BLOCK_BITS // 8
    for level in range(bits):
        ones = (values & values.dtype.type(1 << (bits - 1 - level))) != 0
        packed = np.packbits(ones, bitorder="little")
        blocks, before = [], 0
        for k in range(0, len(packed), step):
            raw = packed[k : k + step].tobytes()
            # A probe tells whether the block can be packed at all: high planes of mixed text can't.
            probe = raw[:2048]
            blob = zlib.compress(raw, 1) if len(zlib.compress(probe, 1)) < 0.95 * len(probe) else raw
            blocks.append([at, len(blob), int(blob is raw), before])
            before += int(np.bitwise_count(packed[k : k + step]).sum())
            blobs.append(blob)
            at += len(blob)
        planes.append({"zeros": len(values) - before, "blocks": blocks})
        values = np.concatenate([values[np.flatnonzero(~ones)], values[np.flatnonzero(ones)]])
    header = json.dumps({"bits": bits, "tokens": len(ids), "docs": len(doc_ids), "directory": len(directory), "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, directory, *blobs])


class WaveletMatrix:
    """A shard's file, read by ranges: ``read(offset, length)`` gives bytes of it."""

    def __init__(self, read):
        magic, size = struct.unpack("<8sI", read(0, 12))
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        head = json.loads(read(12, size))
        self.bits, self.tokens, self.docs, self.planes = head["bits"], head["tokens"], head["docs"], head["planes"]
        self._read, self._directory, self._blocks = read, (12 + size, head["directory"]), 12 + size + head["directory"]
        self._block = lru_cache(4 * self.bits)(self._load)

    def directory(self) -> tuple[list[int | None], np.ndarray]:
        """Keys and lengths of the documents, in order."""
        known, keys, lengths = np.frombuffer(zlib.decompress(self._read(*self._directory)), "<i8").reshape(3, -1)
        return [k if ok else None for ok, k in zip(known.tolist(), keys.tolist())], lengths

    def _load(self, level: int, k: int) -> np.ndarray:
        at, size, raw, _ = self.planes[level]["blocks"][k]
        blob = self._read(self._blocks + at, size)
        return np.frombuffer(blob if raw else zlib.decompress(blob), np.uint8)

    def _bit(self, level: int, at: int) -> int:
        block = self._block(level, at // BLOCK_BITS)
        at %= BLOCK_BITS
        return int(block[at >> 3]) >> (at & 7) & 1

    def _ones(self, level: int, end: int) -> int:
        """Ones of a plane before ``end``."""
        if end >= self.tokens:
            return self.tokens - self.planes[level]["zeros"]
        k, at = divmod(end, BLOCK_BITS)
        block = self._block(level, k)
        tail = int(block[at >> 3]) & ((1 << (at & 7)) - 1) if at & 7 else 0
        return self.planes[level]["blocks"][k][3] + int(np.bitwise_count(block[: at >> 3]).sum()) + tail.bit_count()

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, at)
            ones = self._ones(level, at)
            at = self.planes[level]["zeros"] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.planes[level]["zeros"] + a, self.planes[level]["zeros"] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of an id before ``end`` (of all, without it)."""
        start, end = self._range(value, self.tokens if end is None else end)
        return end - start

    def _select_bit(self, level: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of a plane."""
        low, high = 0, self.tokens
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of an id."""
        start, end = self._range(value, self.tokens)
        if not 0 <= j < end - start:
            raise IndexError(j)
        at = start + j
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.planes[level]["zeros"] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the planes' stable orders undone from the lowest plane up."""
        values = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = [self._load(level, k) for k in range(len(self.planes[level]["blocks"]))]
            if not plane:
                break
            ones = np.unpackbits(np.concatenate(plane), count=self.tokens, bitorder="little").view(bool)
            zeros = self.planes[level]["zeros"]
            above = np.empty_like(values)
            above[~ones] = values[:zeros]
            above[ones] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = above
        return values


def open_shard(uri: str) -> WaveletMatrix:
    """A shard's file opened for range reads."""
    store, path = filesystem(uri)
    file = store.open_input_file(path)
    return WaveletMatrix(lambda at, size: file.read_at(size, at))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), writes the shards, returns their manifest (a stored table).

    Documents are dealt by ranges of doc_id and sorted, so shards follow each other in ascending
    doc_id order: (part, shard). Null doc_ids come first; repeated ones lie in the order of their texts. A
    task writes each file under another name first, so a task run again replaces the same files.
    Manifest: part, shard, path, docs, tokens, start (ids in all shards before).
    """
    columns = ["part", "shard", "path", "docs", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, context = tokenizer(tokenizer_path), TaskContext.get()
        part, rows = context.partitionId(), []
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        keys, parts, held = [], [], 0

        def close():
            nonlocal keys, parts, held
            if keys:
                name = f"{root}/shard-{part:06d}-{len(rows):06d}.wvm"
                draft = f"{name}.{context.taskAttemptId()}"
                with store.open_output_stream(draft) as out:
                    out.write(pack(keys, [len(x) for x in parts], np.concatenate(parts)))
                store.move(draft, name)
                rows.append((part, len(rows), f"{folder}/{name.rpartition('/')[2]}", len(keys), held))
            keys, parts, held = [], [], 0

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist())):
                if held and held + len(ids) + 1 > shard_tokens:
                    close()
                keys.append(key)
                parts.append(np.append(ids, np.uint16(end_id)))
                held += len(ids) + 1
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], columns)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = stored(dealt.mapInArrow(run, "part long, shard long, path string, docs long, tokens long"), "manifest")
    # Starts in two steps: over the parts (a row each), then inside each part.
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    before = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    return shards.join(before, "part").select(*columns, (F.col("part_start") + inside).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = open_shard(path)
                keys, lengths = shard.directory()
                ids = memoryview(shard.decode().astype("<u4").tobytes())
                stops = np.cumsum(lengths)
                sums = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + stops - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Tiny rows that stand for much work: dealt by number, so that they are not gathered in one task.
    tasks = min(MOST_TASKS, max(1, manifest.count()))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all documents' ids (null or empty text: the end id alone) and reads the files back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, tokenizer_path, end_id, folder, shard_tokens))
