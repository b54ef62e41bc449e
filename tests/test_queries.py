"""Each query of the entry module against its SQL, on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from treeline import queries as own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    shown = lambda x: None if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted((tuple(shown(x) for x in row) for row in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query(spark, duck, name):
    got = own.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(own.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(own.QUERIES) <= set(entry.queries())
