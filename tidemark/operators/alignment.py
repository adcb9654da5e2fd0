"""Joins between calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Days of a key that one window holds.
DAYS = 64


def reindex_ffill(left: DataFrame, right: DataFrame, value: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """right's value on left's calendar: exact dates, then the last value carried forward.

    A value dated on a day that the left calendar lacks is dropped, not carried.
    """
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = left.join(right.select(order, value), order, "left")
    return joined.withColumn(value, F.last(value, ignorenulls=True).over(w))


def _nearest(left: DataFrame, right: DataFrame, value: str, order: str, by: list[str] | None, out: str, back: bool) -> DataFrame:
    """left with right's value of the nearest date at or before (back) or at or after its own.

    Both sides go through one ordered window for each key and block of DAYS days; blocks take over what
    the blocks next to them leave, a row for each. So a panel without keys is many tasks, too.
    """
    by = by or []
    names = left.columns
    block = lambda df: df.withColumn("__block", F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / (86400 * DAYS)))
    first, last = (0, 1) if back else (1, 0)
    tagged = block(left).withColumn("__side", F.lit(last)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    other = block(right.where(F.col(value).isNotNull())).select(*by, order, "__block", F.lit(first).alias("__side"), F.col(value).alias("__v"))
    frame = (W.unboundedPreceding, 0) if back else (0, W.unboundedFollowing)
    pick = F.last if back else F.first
    both = tagged.unionByName(other, allowMissingColumns=True)
    filled = both.withColumn("__near", pick("__v", ignorenulls=True).over(W.partitionBy(*by, "__block").orderBy(order, "__side").rowsBetween(*frame)))
    end = (F.max_by if back else F.min_by)("__v", order)
    ends = other.groupBy(*by, "__block").agg(end.alias("__v"))
    asked = tagged.select(*by, "__block").distinct().withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    ends = asked.unionByName(ends).groupBy(*by, "__block").agg(F.max("__v").alias("__v"))
    beyond = (W.unboundedPreceding, -1) if back else (1, W.unboundedFollowing)
    over = W.partitionBy(*(by or [F.lit(1)])).orderBy("__block").rowsBetween(*beyond)  # a row for each block
    carry = ends.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("__block").alias("__at"), pick("__v", ignorenulls=True).over(over).alias("__carry"))
    at = F.col("__block") == F.col("__at")
    for b in by:
        at = at & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    joined = filled.where(F.col("__side") == last).join(carry, at, "left")
    return joined.select(*[n for n in names if n != out], F.coalesce("__near", "__carry").alias(out))


def asof_backward(left: DataFrame, right: DataFrame, value: str, order: str = "date", by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """left with the last right value at or before its date; null values of right are passed over."""
    return _nearest(left, right, value, order, by, out or value, True)


def first_on_or_after(left: DataFrame, right: DataFrame, value: str, order: str = "date", by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """left with the first right value at or after its date; null values of right are passed over."""
    return _nearest(left, right, value, order, by, out or value, False)
