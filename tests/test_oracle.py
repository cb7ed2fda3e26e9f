"""Every query with SQL gives the rows DuckDB gives, on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terraframe import queries as core


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, con, name):
    got = core.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.sql(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
