"""All queries over the driver's tables, and their SQL.

A query is registered with its DuckDB SQL. Its doubles are cut to a number of decimals on
both sides, as window sums differ in their last bits between engines. The cut is not at
the halves, where averages of decimal prices often lie, but at an offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


OFFSET = 0.123456


def cut(df: DataFrame, places: int = 6) -> DataFrame:
    """df with every double cut to so many decimals."""
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    scale = float(10**places)
    return df.select(*[(F.floor(F.col(f"`{c}`") * scale + OFFSET) / scale).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def query(name: str, sql: str | None = None, doubles: str = "", places: int = 6):
    """Registers a query; doubles: names of the SQL's double columns; places: fewer for price levels and smoothed values."""

    def add(build: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: cut(build(spark, sf_dir), places)
        if sql is not None:
            replaced = ", ".join(f"floor({c}::DOUBLE * 1e{places} + {OFFSET}) / 1e{places} AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if replaced else sql
        return build

    return add


from tidemark.plans import (  # noqa: E402,F401  each module registers its queries
    query_forecast,
    query_indicators,
    query_store,
    query_studies,
)
