"""WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (each
record its own gzip member) and ``indexes/index.cdx`` (a line for each record: page, offset, length).
The reader finds the end record, follows the ZIP64 locator where sizes or counts overflow, parses
the central directory, and from then on reads only ranges: the index member, and records inside the
stored data member. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import filesystem, new_folder, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads of at least so many bytes may be revisits of an equal one.
LEAST_BYTES = 1000
#: Bytes of a data member after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Tasks of the reading stages, at most.
MOST_TASKS = 20_000
#: Records that a reading task takes in one block, at most.
BLOCK_RECORDS = 2000

_FIXED_TIME = "2024-01-01T00:00:00Z"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


class ArchiveWriter:
    """Writes one archive front to back; sizes follow the data in a ZIP64 descriptor."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        raw = name.encode()
        self.name, self.start, self.crc = raw, self.at, 0
        # Flag 8: sizes come after the data. The ZIP64 field makes them 64 bits wide there.
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, _FULL32, _FULL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.body = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def close_member(self) -> None:
        size = self.at - self.body
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.members.append((self.name, self.start, size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, offset, size, crc in self.members:
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, _FULL32, _FULL32, len(name), 28, 0, 0, 0, 0, _FULL32) + name + struct.pack("<HHQQQ", 1, 24, size, size, offset))
        size, count, end = self.at - start, len(self.members), self.at
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0))


class Archive:
    """Directory of a ZIP file through ``read(offset, length)`` and its size."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - (22 + _FULL16))
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature inside a comment
        if at < 0:
            raise ValueError("not a ZIP file: no end record")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if _FULL16 == count or _FULL32 in (length, offset):
            where = tail_at + at - 20
            locator = read(where, 20) if where >= 0 else b""
            if locator[:4] == b"PK\x06\x07":
                record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 locator leads to no ZIP64 end record")
                count, length, offset = struct.unpack_from("<QQQ", record, 32)
        directory, self.members, at = read(offset, length), {}, 0
        for _ in range(count):
            fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
            if fields[0] != 0x02014B50:
                raise ValueError("broken central directory")
            method, packed, full, n, m, k, local = fields[4], fields[8], fields[9], fields[10], fields[11], fields[12], fields[16]
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if fields[3] & 0x800 else "cp437")
            extra, spot = directory[at + 46 + n : at + 46 + n + m], 0
            while spot + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, spot)
                if kind == 1:  # only the fields that overflow, in this order
                    wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, spot + 4))
                    full = next(wide) if full == _FULL32 else full
                    packed = next(wide) if packed == _FULL32 else packed
                    local = next(wide) if local == _FULL32 else local
                spot += 4 + width
            self.members[name] = (method, local, packed, full)
            at += 46 + n + m + k

    def stored_at(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes."""
        method, local, packed, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members are read by ranges")
        head = self.read(local, 30)
        n, m = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + m, packed


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record in a gzip member. A revisit has no block, only what it refers to."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_FIXED_TIME}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + payload + b"\r\n\r\n") + packer.flush()


def parse(blob: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    raw = zlib.decompress(blob, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return headers, rest[:size]


def classify(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest, refers_to for each (page_id, digest): the largest page_id of an equal payload.

    refers_to is null for responses: small payloads, the largest page_id itself, a null page_id.
    """
    rows = pages.select("page_id", F.sha1("payload").alias("digest"), (F.octet_length("payload") >= least).alias("large")).distinct()
    rows = stored(rows, "payloads")
    last = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    marked = rows.join(last, "digest")
    return marked.where("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns archives and their record counts.

    Null html is an empty payload; a null url has no target line. Rows that repeat a page_id are
    each a record. A task writes under another name first, so one run again replaces its files.
    """
    names = ["path", "records"]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    revisits = classify(rows, least).withColumnRenamed("page_id", "page").withColumnRenamed("digest", "same")
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("page")) & (F.col("digest") == F.col("same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store_root, done = TaskContext.get(), filesystem(folder), []
        store, root = store_root
        store.create_dir(root, recursive=True)
        archive, lines = None, []

        def begin():
            name = f"{root}/part-{context.partitionId():06d}-{len(done):06d}.wacz"
            out = store.open_output_stream(f"{name}.{context.taskAttemptId()}")
            writer = ArchiveWriter(out)
            writer.open(DATA)
            return name, out, writer

        def finish():
            name, out, writer = archive
            writer.close_member()
            writer.open(INDEX)
            writer.write("".join(lines).encode())
            writer.close_member()
            writer.close()
            out.close()
            store.move(f"{name}.{context.taskAttemptId()}", name)
            done.append((f"{folder}/{name.rpartition('/')[2]}", len(lines)))

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive, lines = begin(), []
                writer = archive[2]
                blob = record(page, url, payload, digest, "response" if refers is None else "revisit", refers)
                lines.append(f"{'' if page is None else page} {writer.at - writer.body} {len(blob)}\n")
                writer.write(blob)
                if writer.at - writer.body >= archive_bytes:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names)

    written = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long")
    return stored(written, "archives")


def open_archive(uri: str) -> Archive:
    """An archive opened for range reads."""
    store, path = filesystem(uri)
    file = store.open_input_file(path)
    return Archive(lambda at, size: file.read_at(size, at), file.size())


def record_ranges(archives: DataFrame, block: int = BLOCK_RECORDS, tasks: int = 1) -> DataFrame:
    """path, offsets, lengths: blocks of records, found through the stored index members."""
    names = ["path", "offsets", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                archive = open_archive(path)
                data, _ = archive.stored_at(DATA)
                lines = archive.read(*archive.stored_at(INDEX)).decode().splitlines()
                spans = [(data + int(a), int(b)) for a, b in (x.split(" ")[1:] for x in lines)]
                parts = [spans[k : k + block] for k in range(0, len(spans), block)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts)), pa.array([[s for s, _ in p] for p in parts]), pa.array([[n for _, n in p] for p in parts])], names)

    return archives.select("path").repartition(tasks, "path").mapInArrow(run, "path string, offsets array<long>, lengths array<long>")


def read_archives(archives: DataFrame, block: int = BLOCK_RECORDS) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record, by range reads.

    A response's digest and size are those of the payload as read; a revisit's are those it carries.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def number(x: str) -> int | None:
        digits = x.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = filesystem(path)
                rows = []
                with store.open_input_file(inner) as file:
                    for at, size in zip(offsets, lengths):
                        headers, payload = parse(file.read_at(size, at))
                        kind = headers["WARC-Type"]
                        if kind == "response":
                            full, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            full, digest = int(headers["X-Payload-Length"]), base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        refers = headers.get("WARC-Refers-To")
                        rows.append((number(headers["WARC-Record-ID"]), full, digest, kind, number(refers) if refers else None, headers.get("WARC-Target-URI")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    # Tiny rows that stand for much work: dealt by number, so that they are not gathered in one task.
    size = archives.agg(F.count("*").alias("n"), F.sum(F.ceil(F.col("records") / block)).alias("blocks")).first()
    ranges = record_ranges(archives, block, min(MOST_TASKS, max(1, size["n"]))).repartition(min(MOST_TASKS, max(1, size["blocks"] or 0)))
    return ranges.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads the records back."""
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "archives"), least))


#: DuckDB SQL for what the records say.
SQL = """
WITH p AS (
  SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes
  FROM pages
), l AS (
  SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN l USING (payload_digest)
"""
