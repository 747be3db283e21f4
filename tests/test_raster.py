"""Rasters as a data source: round trips, filters that read less, missing rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from catchment.sources import raster


@pytest.fixture
def written(spark, tmp_path):
    r = np.random.default_rng(3)
    cells = {(int(a), int(b)): float(np.float32(r.normal())) for a, b in r.integers(0, (100, 30), (900, 2))}
    rows = [(a, b, v) for (a, b), v in cells.items()] + [(5, 40, 1.0), (-1, 0, 1.0), (None, 1, 1.0), (99, 29, None), (98, 0, float("nan"))]
    cells |= {(99, 29): cells.get((99, 29)), (98, 0): cells.get((98, 0))}
    path = f"file://{tmp_path}/grid"
    raster.write_raster(spark.createDataFrame(rows, "row int, col int, value double").repartition(7), path, 100, 30, file_rows=16)
    return path, cells


def test_round_trip(spark, written):
    path, cells = written
    table = raster.read_raster(spark, path, 8)
    got = {(r["row"], r["col"]): r["value"] for r in table.collect()}
    assert got == {(a, b): cells.get((a, b)) for a in range(100) for b in range(30)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = raster.read_raster(spark, path, 8).where("row >= 20 and row < 30 and col = 7 and value is not null")
        assert {(r["row"], r["col"]): r["value"] for r in part.collect()} == {k: v for k, v in cells.items() if 20 <= k[0] < 30 and k[1] == 7 and v is not None}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_read_fewer_bytes(written):
    path, _ = written
    size = lambda reader: sum(4 * reader.cols * p.count for p in reader.partitions() if p.file)
    whole, part = raster.Reader({"path": path}), raster.Reader({"path": path, "taskRows": "4"})
    left = list(part.narrow([GreaterThan(("row",), 19), LessThanOrEqual(("row",), 29), EqualTo(("col",), 7), EqualTo(("value",), 1.0)]))
    assert [type(f) for f in left] == [EqualTo] and left[0].attribute == ("value",)
    assert size(part) == 4 * 30 * 10 and size(whole) == 4 * 30 * 100
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows == p.count for p in part.partitions() for b in part.read(p))
    list(part.narrow([EqualTo(("row",), 1000)]))
    assert [b for p in part.partitions() for b in part.read(p)] == []


def test_missing_rows_are_nodata(spark, tmp_path):
    path = f"file://{tmp_path}/sparse"
    raster.write_raster(spark.createDataFrame([(40, 1, 5.0)], "row int, col int, value double"), path, 64, 2, file_rows=8)
    got = raster.read_raster(spark, path).collect()
    assert len(got) == 128 and [(r["row"], r["col"], r["value"]) for r in got if r["value"] is not None] == [(40, 1, 5.0)]
    none = f"file://{tmp_path}/none"
    raster.write_raster(spark.createDataFrame([], "row int, col int, value double"), none, 3, 2)
    assert [r["value"] for r in raster.read_raster(spark, none).collect()] == [None] * 6
