"""Every query with SQL against DuckDB on the small tables, through the entry point."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from notelake.plans import catalog

FOLDER = os.environ.get("NOTELAKE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else repr(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, found.fetchall())


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
