"""The queries of the subpackage that have SQL give the rows that DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from rowmill.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DIR).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(repr([None if x is None or pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)
