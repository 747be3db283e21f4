"""The stream of least flows gives what the table gives, whatever the order, repeats and late rows."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from catchment.streaming import lowflow


def test_stream_of_low_flows(spark, tmp_path):
    r = np.random.default_rng(5)
    start = datetime.date(2019, 2, 20)
    rows = [(u, start + datetime.timedelta(k), None if r.random() < 0.02 else float(r.integers(0, 50))) for u in ("a", "b") for k in range(800) if r.random() > 0.05]
    rows += rows[10:40] + [(None, start, 1.0), ("a", None, 1.0)]
    order = np.argsort([((x[1] or start) - start).days + r.uniform(0, 8) for x in rows])
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    shape = "u string, d date, q double"
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)
    parts = [[rows[k] for k in part] for part in np.array_split(order, 5)]
    # A row that comes far too late, and at last one that moves the watermark past everything.
    parts += [[("a", datetime.date(2018, 5, 5), 0.0), ("c", datetime.date(2030, 1, 1), 1.0)], [("c", datetime.date(2030, 2, 1), 1.0)]]
    query = lowflow.low_flow_stream(stream, "u", "d", "q", 7, 4).writeStream.format("memory").queryName("low_flows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
    finally:
        query.stop()
    key = lambda row: (row["unit"], row["hydro"], row["least"], row["rows"])
    batch = lowflow.yearly_low_flows(spark.createDataFrame(rows, shape), "u", "d", "q", 7, 4)
    want = sorted(map(key, batch.collect()))
    got = sorted(map(key, spark.table("low_flows").where(F.col("unit") != "c").collect()))
    assert got == want and len(want) == 8


def test_state_stays_small():
    own = lowflow._Unit(None, 7, 1)
    for day in range(5000):
        own.add(day, 1.0)
        own.settle(day - 9)
        assert len(own.open) <= 10 and len(own.tail) <= 7
    assert lowflow._Unit(None, 3, 1).settle(10) == []
