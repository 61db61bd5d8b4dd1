"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rowmill import catalogue

DIR = "/root/testdata/sf0.001"


def same(a, b):
    def rows(df):
        cols = sorted(df.columns)
        df = df[cols].astype(object).where(df[cols].notna(), None)
        return cols, sorted(repr(tuple(float(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r)) for r in df.itertuples(index=False, name=None))

    return rows(a) == rows(b)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR).toPandas()
    if name in catalogue.oracle_sql():
        assert same(got, duck.sql(catalogue.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
