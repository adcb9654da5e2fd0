"""Greedy choices of positions that are some rows apart: folds over sorted arrays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<bigint>"


def thin_positions(positions: Column, gap: int) -> Column:
    """Ascending array -> positions kept: each at least gap after the last kept one."""
    return F.aggregate(
        positions, F.array().cast(EMPTY), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc)
    )


def greedy_thin(candidates: DataFrame, gap: int, by: list[str], pos: str = "pos") -> DataFrame:
    """candidates (by..., pos) -> the kept rows' keys and positions."""
    grouped = candidates.groupBy(*by).agg(thin_positions(F.sort_array(F.collect_list(F.col(pos).cast("bigint"))), gap).alias("kept"))
    return grouped.select(*by, F.explode("kept").alias(pos))


def thin_by_distance(nearest: Column, gap: int, most: int, start: Column | None = None) -> Column:
    """Array of positions in the order of distance -> kept: gap rows from all kept ones, at most `most`, after those of start."""
    first = start if start is not None else F.array().cast(EMPTY)
    return F.aggregate(
        nearest,
        first,
        lambda acc, x: F.when((F.size(acc) < most) & F.forall(acc, lambda k: F.abs(x - k) >= gap), F.concat(acc, F.array(x))).otherwise(acc),
    )
