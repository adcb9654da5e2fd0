"""What followed each position: forward returns, excursions, paths, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.windows import position, series


def forward_stats(bars: DataFrame, horizons: list[int], bench: str | None = None) -> DataFrame:
    """One row per bar and horizon: ret, mae, mfe (and excess over the aligned column bench), null until h rows follow.

    Computed once for all rows with windows; no self-join.
    """
    w = series()
    base = bars.withColumn("pos", position())
    per = []
    for h in horizons:
        there = F.lead("close", h).over(w)
        frame = w.rowsBetween(0, h)
        fields = [F.lit(h).alias("h"), (there / F.col("close") - 1).alias("ret"), F.when(there.isNotNull(), F.min("close").over(frame) / F.col("close") - 1).alias("mae"), F.when(there.isNotNull(), F.max("close").over(frame) / F.col("close") - 1).alias("mfe")]
        if bench:
            fields.append((there / F.col("close") - F.lead(bench, h).over(w) / F.col(bench)).alias("excess"))
        per.append(F.struct(*fields))
    out = base.withColumn("__f", F.array(*per)).withColumn("__f", F.explode("__f"))
    names = ["h", "ret", "mae", "mfe"] + (["excess"] if bench else [])
    return out.select(*base.columns, *[F.col(f"__f.{n}").alias(n) for n in names])


def forward_paths(bars: DataFrame, horizon: int, step: int) -> DataFrame:
    """symbol, date, n, path (every step-th close from 100), worst, days_to_trough over the next rows."""
    ahead = F.collect_list("close").over(series().rowsBetween(0, horizon))
    x = bars.withColumn("l", ahead)
    first = F.element_at("l", 1)
    path = F.transform(F.filter("l", lambda v, i: i % step == 0), lambda v: v / first * 100)
    low = F.array_min("l")
    return x.select("symbol", "date", F.size("l").alias("n"), path.alias("path"), (low / first - 1).alias("worst"), (F.array_position("l", low) - 1).cast("int").alias("days_to_trough"))


def horizon_stats(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """outcomes (keys..., date, ret, mae, excess, regime) -> n, p_positive, p_beat, q20, q50, q80, expected_mae, mean_excess, first, last, regimes."""
    done = outcomes.where("ret is not null")
    yes = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).when(F.col(c).isNotNull(), 0.0))
    q = lambda p: F.percentile("ret", p)
    return done.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), yes("ret").alias("p_positive"), yes("excess").alias("p_beat"), q(0.2).alias("q20"), q(0.5).alias("q50"), q(0.8).alias("q80"),
        F.avg("mae").alias("expected_mae"), F.avg("excess").alias("mean_excess"), F.min("date").alias("date_start"), F.max("date").alias("date_end"), F.count_distinct("regime").alias("regimes"),
    )


def median_path(paths: DataFrame, by: str) -> DataFrame:
    """by, idx, median: elementwise over complete paths, cut to the shortest."""
    x = paths.withColumn("__n", F.min(F.size("path")).over(W.partitionBy(by)))
    e = x.select(by, "__n", F.posexplode("path").alias("idx", "v")).where("idx < __n")
    return e.groupBy(by, "idx").agg(F.percentile("v", 0.5).alias("median"))
