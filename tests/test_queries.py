"""Every query with SQL against DuckDB, at the smallest scale."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
            return round(float(v), 4) + 0.0
        return str(v)

    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df = df.assign(**{c: df[c].astype("datetime64[us]").astype(str)})
    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-4 * max(1, abs(v))), (x, y)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry_has_rows(spark):
    assert entry.entry(spark).columns
