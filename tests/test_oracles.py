"""Every query with SQL of its own gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)) or type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).values.tolist()), key=str)


def same(a, b):
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for v, w in zip(x, y):
            if isinstance(v, float) and isinstance(w, float):
                if abs(v - w) > 2e-6 * max(1.0, abs(v)):
                    return False
            elif v != w:
                return False
    return True


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query(spark, duck, name):
    mine = entry.queries()[name](spark, FOLDER).toPandas()
    other = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert same(rows(mine), rows(other))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
