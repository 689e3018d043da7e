"""Every registered query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(name, spark, duck):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
