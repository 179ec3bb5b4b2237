"""The queries of this subpackage that have SQL, against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from notelake.llm import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    found = c.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    df = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).limit(1).count() == 1
