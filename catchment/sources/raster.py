"""Float rasters as a Spark data source: a header and files of whole rows, read by ranges of rows.

A raster is a folder with ``grid.hdr`` (ncols, nrows, nodata, a name and a number a line) and files
``rows-<first row>.flt`` of little-endian 32-bit floats, row after row. A task reads one range of rows of one file;
filters on ``row`` choose ranges and filters on ``col`` the cells of a row, and a column that isn't asked for isn't made. Cells that
hold nodata are null. Rows that no file has are nodata, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME, SCHEMA = "float_raster", "row int, col int, value float"
#: Rows of a file as written, and of a task as read; the value that stands for no data.
FILE_ROWS, TASK_ROWS, NODATA = 256, 256, -9999.0


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``first + count`` of the raster, from byte ``offset`` of a file (null: rows that no file has)."""

    file: str | None
    offset: int
    first: int
    count: int


def header(path: str) -> dict[str, float]:
    store, inner = _filesystem(path)
    with store.open_input_file(f"{inner}/grid.hdr") as file:
        return {k.lower(): float(v) for k, v in (line.split() for line in file.read().decode().splitlines() if line.strip())}


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.task_rows = options["path"], int(options.get("taskRows", TASK_ROWS))
        head = header(self.path)
        self.cols, self.rows, self.nodata = int(head["ncols"]), int(head["nrows"]), np.float32(head.get("nodata", NODATA))
        self.bounds = {"row": [0, self.rows - 1], "col": [0, self.cols - 1]}

    def narrow(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of row and col with a number narrow the ranges; the others are left to Spark."""
        for f in filters:
            name, value = (f.attribute[0], f.value) if hasattr(f, "attribute") and hasattr(f, "value") and len(f.attribute) == 1 else ("", None)
            if name not in self.bounds or not isinstance(value, int) or type(f) not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
                continue
            low, high = self.bounds[name]
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = max(low, value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = min(high, value - isinstance(f, LessThan))
            self.bounds[name] = [low, high]

    def partitions(self) -> list[Rows]:
        store, inner = _filesystem(self.path)
        low, high = self.bounds["row"]
        files = sorted((int(x.base_name[5:-4]), x.path, x.size) for x in store.get_file_info(pafs.FileSelector(inner)) if x.base_name.startswith("rows-") and x.base_name.endswith(".flt"))
        out, at = [], low
        for first, path, size in [*files, (self.rows, None, 0)]:
            stop = min(high + 1, first)
            out += [Rows(None, 0, k, min(self.task_rows, stop - k)) for k in range(at, stop, self.task_rows)]
            held = size // (4 * self.cols) if self.cols else 0
            start, stop = max(at, first), min(high + 1, first + held)
            out += [Rows(path, 4 * self.cols * (k - first), k, min(self.task_rows, stop - k)) for k in range(start, stop, self.task_rows)]
            at = max(at, stop)
        return out or [Rows(None, 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        low, high = self.bounds["col"]
        width = max(0, high + 1 - low)
        if not part.count or not width:
            return
        values = np.full((part.count, self.cols), self.nodata, "<f4")
        if part.file is not None:
            store, _ = _filesystem(self.path)
            with store.open_input_file(part.file) as file:
                values = np.frombuffer(file.read_at(4 * self.cols * part.count, part.offset), "<f4").reshape(part.count, self.cols)
        values = values[:, low : high + 1].ravel()
        row = np.repeat(np.arange(part.first, part.first + part.count, dtype=np.int32), width)
        col = np.tile(np.arange(low, high + 1, dtype=np.int32), part.count)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(values.astype(np.float32), mask=values == self.nodata)], ["row", "col", "value"])


class NarrowingReader(Reader):
    """The reader of sessions that push filters into Python sources; others refuse a reader with this method."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.narrow(filters)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Writes the files of rows that a task holds whole; ``write_raster`` deals the cells so."""

    def __init__(self, options: dict):
        self.path, self.cols, self.rows = options["path"], int(options["cols"]), int(options["rows"])
        self.nodata, self.file_rows = float(options.get("nodata", NODATA)), int(options.get("fileRows", FILE_ROWS))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, inner = _filesystem(self.path)
        store.create_dir(inner)
        files: list[str] = []
        block, at = None, -1

        def close() -> None:
            if block is not None:
                name = f"{inner}/rows-{at * self.file_rows:010d}.flt"
                # Under another name first, so that a task run again replaces its own file.
                with store.open_output_stream(f"{name}.{id(block)}.tmp") as out:
                    out.write(block.tobytes())
                store.move(f"{name}.{id(block)}.tmp", name)
                files.append(name)

        for batch in batches:
            row, col, value = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "col", "value"))
            row, col = np.asarray(row), np.asarray(col)
            value = np.asarray(value.fill_null(self.nodata), "<f4")
            for k in np.unique(row // self.file_rows):
                if k != at:
                    close()
                    at = int(k)
                    block = np.full((min(self.file_rows, self.rows - at * self.file_rows), self.cols), self.nodata, "<f4")
                own = row // self.file_rows == k
                block[row[own] - at * self.file_rows, col[own]] = value[own]
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = _filesystem(self.path)
        store.create_dir(inner)
        with store.open_output_stream(f"{inner}/grid.hdr") as out:
            out.write(f"ncols {self.cols}\nnrows {self.rows}\nnodata {self.nodata!r}\n".encode())


class FloatRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (NarrowingReader if self.options.get("narrow") == "true" else Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read_raster(spark: SparkSession, path: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """row, col, value of every cell of a raster. Filters reach the files in sessions with ``spark.sql.python.filterPushdown.enabled``."""
    spark.dataSource.register(FloatRaster)
    narrow = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("taskRows", task_rows).option("narrow", narrow).load(path)


def write_raster(cells: DataFrame, path: str, rows: int, cols: int, nodata: float = NODATA, file_rows: int = FILE_ROWS) -> None:
    """Writes a table of cells (row, col, value) as a raster of ``rows`` times ``cols``.

    Cells outside, and those with a null row or column, are left out; missing cells, nulls and nan are nodata; of a cell that is given
    twice the greatest value counts. Tasks write whole files, ``file_rows`` rows each.
    """
    cells.sparkSession.dataSource.register(FloatRaster)
    inside = cells.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    value = F.when(~F.isnan(F.col("value").cast("float")), F.col("value").cast("float"))
    one = inside.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.max(value).alias("value"))
    file = F.floor(F.col("row") / file_rows)
    dealt = one.withColumn("_file", file).repartition("_file").sortWithinPartitions("_file", "row", "col").drop("_file")
    dealt.write.format(NAME).options(rows=rows, cols=cols, nodata=nodata, fileRows=file_rows).mode("append").save(path)
