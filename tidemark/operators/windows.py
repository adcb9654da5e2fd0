"""Window operators over ordered series: one partition per symbol, ordered by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(key: str = "symbol", order: str = "date"):
    return W.partitionBy(key).orderBy(order)


def trailing(n: int, key: str = "symbol", order: str = "date"):
    return series(key, order).rowsBetween(-(n - 1), 0)


def position(key: str = "symbol", order: str = "date") -> Column:
    """0-based row ordinal in a symbol's own calendar."""
    return F.row_number().over(series(key, order)).cast("long") - 1


def n_bar_return(c: str, n: int, w=None) -> Column:
    return F.try_divide(F.col(c), F.lag(c, n).over(w or series())) - 1


def rolling(agg, c: str, n: int, min_periods: int | None = None, key: str = "symbol", order: str = "date") -> Column:
    """agg(c) over the last n rows, null until min_periods (n by default) values are there."""
    w = trailing(n, key, order)
    return F.when(F.count(c).over(w) >= (min_periods or n), agg(c).over(w))


def ewm(df: DataFrame, c: str, alpha: float, out: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """Exponentially weighted mean, y0 = x0 and y = (1-alpha) y + alpha x, seeded by the first non-null value.

    A scaled cumulative sum: no fold and no Python. (1-alpha)**-t must stay a double, so
    rows are cut into blocks of SPAN values; a block starts from the last value of the one
    before, found by a second, per-block pass (a row per block).
    """
    span = 1500
    w = series(key, order)
    t = F.when(F.col(c).isNotNull(), F.count(c).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    df = df.withColumn("__t", t).withColumn("__b", F.floor(F.col("__t") / span)).withColumn("__k", F.col("__t") % span)
    z = F.when(F.col("__t") == 0, F.col(c)).otherwise(F.lit(alpha) * F.col(c)) * F.pow(F.lit(1 - alpha), -F.col("__k"))
    in_block = W.partitionBy(key, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__y", F.when(F.col("__t").isNotNull(), F.sum(z).over(in_block) * F.pow(F.lit(1 - alpha), F.col("__k"))))
    # what the blocks before leave: the last one's own value, and the one before it decayed by a whole block (under 1e-40)
    last = F.last("__y", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("__last", last)
    before = F.when((F.col("__k") == 0) & (F.col("__b") > 0), F.lag("__last").over(w))
    df = df.withColumn("__c", before).withColumn("__c", F.last("__c", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    carried = F.coalesce(F.col("__c"), F.lit(0.0)) * F.pow(F.lit(1 - alpha), F.col("__k") + 1)
    return df.withColumn(out, F.when(F.col("__b") > 0, F.col("__y") + carried).otherwise(F.col("__y"))).drop("__t", "__b", "__k", "__y", "__last", "__c")


def fill_forward(c: str, key: str | None = "symbol", order: str = "date") -> Column:
    w = (W.partitionBy(key) if key else W.partitionBy(F.lit(1))).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return F.last(c, ignorenulls=True).over(w)


def with_streak(df: DataFrame, flag: Column, out: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """out: rows up to this one since the flag was last not true (null counts as false)."""
    w = series(key, order)
    df = df.withColumn("__pos", F.row_number().over(w))
    off = F.when(~F.coalesce(flag, F.lit(False)), F.col("__pos"))
    last = F.max(off).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, (F.col("__pos") - F.coalesce(last, F.lit(0))).cast("long")).drop("__pos")


def with_runs(df: DataFrame, label: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """run: number of the maximal run of equal labels a row belongs to."""
    w = series(key, order)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    df = df.withColumn("__new", new)
    return df.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def percent_rank_average(c: str, by: str) -> Column:
    """Average rank over count of non-null values: not SQL's percent_rank."""
    w = W.partitionBy(by)
    ties = F.count(c).over(W.partitionBy(by, c))
    return F.when(F.col(c).isNotNull(), (F.rank().over(w.orderBy(F.col(c).asc_nulls_last())) + (ties - 1) / 2) / F.count(c).over(w))


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
