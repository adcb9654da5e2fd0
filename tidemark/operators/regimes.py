"""Regime labels of aligned series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.windows import rolling, series

UNKNOWN = "unknown"
CREDIT_LOOKBACK, CREDIT_CHANGE = 1260, 63


def vix_label(v: Column) -> Column:
    return F.when(v < 20, "calm").when(v <= 30, "elevated").when(v > 30, "stressed").otherwise(UNKNOWN)


def trend_label(close: Column, ma: Column) -> Column:
    return F.when(ma.isNull() | close.isNull(), UNKNOWN).when(close >= ma, "above").otherwise("below")


def rank_in_window(c: str, n: int, w) -> Column:
    """Percent of the last n values strictly below the current one; null until n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    values = F.collect_list(c).over(frame)
    return F.when(F.size(values) >= n, F.size(F.filter(values, lambda x: x < F.element_at(values, -1))) * 100.0 / n)


def credit_label_percentile(credit: DataFrame, lookback: int = CREDIT_LOOKBACK) -> DataFrame:
    """date, credit -> also change, pct, credit_label. A macro series is one ordered calendar of a few thousand days."""
    w = W.partitionBy(F.lit(1)).orderBy("date")
    changed = credit.withColumn("change", F.col("credit") - F.lag("credit", CREDIT_CHANGE).over(w))
    valid = changed.where("change is not null").withColumn("pct", rank_in_window("change", lookback, w))
    out = changed.join(valid.select("date", "pct"), "date", "left")
    label = F.when(F.col("pct") >= 80, "widening").when(F.col("pct") <= 20, "narrowing").when(F.col("pct").isNotNull(), "flat").otherwise(UNKNOWN)
    return out.withColumn("credit_label", label)


def change_label(c: str, n: int, band: float, up: str, down: str, w) -> Column:
    change = F.col(c) - F.lag(c, n).over(w)
    return F.when(change > band, up).when(change < -band, down).when(change.isNotNull(), "flat").otherwise(UNKNOWN)


def trend_own_calendar(bench: DataFrame, n: int = 200) -> DataFrame:
    """date, trend: average on the benchmark's own calendar."""
    one = bench.withColumn("symbol", F.lit("*"))
    return one.withColumn("ma", rolling(F.avg, "bench", n)).select("date", trend_label(F.col("bench"), F.col("ma")).alias("trend"))


def with_regimes(bars: DataFrame, vix: DataFrame, credit: DataFrame, bench: DataFrame, lookback: int = CREDIT_LOOKBACK) -> DataFrame:
    """bars with vix_label, credit_label and trend on each symbol's calendar: exact dates, then carried forward."""
    labels = credit_label_percentile(credit, lookback).select("date", "credit_label")
    out = bars.join(vix, "date", "left").join(labels, "date", "left").join(trend_own_calendar(bench), "date", "left")
    w = series().rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("vix_label", vix_label(F.last("vix", ignorenulls=True).over(w)))
    for c in ("credit_label", "trend"):
        out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(UNKNOWN)))
    return out


def leadership(panel: DataFrame, groups: DataFrame, bench: DataFrame, threshold: float = 2.0, n: int = 63) -> DataFrame:
    """date -> leader, spread (percentage points): the group whose mean n-day return differs most from the benchmark's.

    groups: grp, ord, symbol. Ties go to the first group in order; none: unknown.
    """
    w = series()
    rets = panel.withColumn("ret", F.try_divide("close", F.lag("close", n).over(w)) - 1).where("ret is not null")
    one = bench.withColumn("symbol", F.lit("*"))
    base = one.withColumn("base", F.try_divide("bench", F.lag("bench", n).over(w)) - 1).select("date", "base")
    by = rets.join(F.broadcast(groups), "symbol").groupBy("date", "grp", "ord").agg(F.avg("ret").alias("ret"))  # groups: a configuration, a few rows
    diff = by.join(base, "date").withColumn("spread", (F.col("ret") - F.col("base")) * 100).where("spread is not null")
    best = diff.groupBy("date").agg(F.max_by(F.struct("grp", "spread"), F.struct(F.abs("spread"), -F.col("ord"))).alias("b"))
    label = (
        F.when(F.col("b.spread") >= threshold, F.concat("b.grp", F.lit("-led")))
        .when(F.col("b.spread") <= -threshold, F.concat(F.lit("anti-"), F.col("b.grp")))
        .otherwise("broad")
    )
    out = one.select("date").join(best, "date", "left")
    return out.select("date", F.when(F.col("b").isNull(), UNKNOWN).otherwise(label).alias("leader"), F.col("b.spread").alias("spread"))
