"""The exact search among vectors: every pair counts, ranks and ties are SQL's, and it ends on larger tables."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans.analogs import nearest_vectors

COLS = "vec_id other dist rk".split()


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """15,000 vectors of 64 elements, of which 300 equal another."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(15000, 64)).astype("float32")
    x[rng.integers(0, 15000, 300)] = x[7]
    path = tmp_path_factory.mktemp("vectors")
    pd.DataFrame({"vec_id": np.arange(15000), "embedding": list(x), "label": np.int32(0)}).to_parquet(path / "embeddings.parquet")
    return str(path)


def by_sql(name: str, path: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchdf()


def same_in_time(spark, name: str, path: str, cols: list[str], most_s: float) -> None:
    began = time.time()
    got = entry.queries()[name](spark, path).toPandas()
    took = time.time() - began
    got, want = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, by_sql(name, path)))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    assert took < most_s, took


def test_knn_of_many_vectors_is_sql_and_ends(spark, larger):
    same_in_time(spark, "j13_knn_embeddings", larger, COLS, 25)


def brute(rows: list, asked: list, k: int) -> list:
    out = []
    for p, x in asked:
        if p is None or x is None or None in x:
            continue
        found = []
        for o, y in rows:
            if o is not None and o < p and y is not None and None not in y and len(y) == len(x):
                total = 0.0
                for a, b in zip(x, y):
                    total += (b - a) * (b - a)
                found.append((np.isnan(total), 0.0 if np.isnan(total) else float(np.sqrt(total)), o))
        out += [(p, o, "nan" if bad else d, i + 1) for i, (bad, d, o) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_vectors_in_small_blocks_with_odd_values(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (240, 3)).astype(float).tolist()  # many ties
    x[3], x[50], x[51], x[90] = None, [1.0, None, 0.0], [1.0, 2.0], [float("nan"), 0.0, 0.0]
    x[100], x[120], x[140] = [1e200, 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 1.0]
    rows = [(int(i * i * 1000 - 300_000), v) for i, v in enumerate(x)] + [(None, [0.0, 0.0, 0.0])]  # gaps, negative positions
    df = spark.createDataFrame(rows, "pos long, x array<double>")
    asked = df.where(F.col("pos").isNull() | (F.col("pos") % 3 == 0))
    got = nearest_vectors(df, asked, 5, query_block=16, row_block=20).collect()
    got = sorted([(r.query_pos, r.pos, "nan" if np.isnan(r.dist) else r.dist, r.rk) for r in got], key=str)
    assert got == brute(rows, [r for r in rows if r[0] is None or r[0] % 3 == 0], 5)
    assert nearest_vectors(df.limit(0), asked, 5).count() == 0 and nearest_vectors(df, asked.limit(0), 5).count() == 0


def test_distance_thinning_of_many_vectors_is_sql_and_ends(spark, larger):
    same_in_time(spark, "w10_distance_thinning", larger, ["query_pos", "pos", "nth"], 25)
