"""Trigger studies: indicators, triggers, samplings, episodes and conjunction claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.thinning import greedy_thin
from tidemark.operators.windows import n_bar_return, position, rolling, series


def indicators(bars: DataFrame) -> DataFrame:
    b = bars.withColumn("ma200", rolling(F.avg, "close", 200)).withColumn("ma50", rolling(F.avg, "close", 50)).withColumn("hi20", rolling(F.max, "close", 20))
    b = b.withColumn("ext", F.col("close") / F.col("ma200") - 1).withColumn("from_hi20", F.col("close") / F.col("hi20") - 1)
    return b.withColumn("trail126", n_bar_return("close", 126)).withColumn("trail252", n_bar_return("close", 252)).withColumn("pos", position())


def trigger_columns(x: DataFrame, ext: float = 0.30, trail: float = 0.40, hi20: float = -0.02, strength: float = 0.30) -> DataFrame:
    no = F.lit(False)
    return x.withColumns(
        {
            "ext200": F.coalesce((F.col("ext") >= ext) & (F.col("trail126") >= trail), no),
            "strength": F.coalesce((F.col("from_hi20") >= hi20) & (F.col("trail126") >= strength), no),
            "tsmom_pos": F.coalesce(F.col("trail252") > 0, no),
            "tsmom_neg": F.coalesce(F.col("trail252") <= 0, no),
        }
    )


def tag_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """rows with the tag of the first period (ord, a, b, tag) their date is in, else unknown. Periods are a small configuration."""
    dates = rows.select("date").distinct()
    hit = dates.join(F.broadcast(periods), F.col("date").between(F.col("a"), F.col("b"))).groupBy("date").agg(F.min_by("tag", "ord").alias("tag"))
    return rows.join(hit, "date", "left").withColumn("tag", F.coalesce("tag", F.lit("unknown"))).select(*rows.columns, "tag")


def crossed(x: DataFrame, flag: str) -> DataFrame:
    """Rows where the flag turns true (not a symbol's first row)."""
    before = F.lag(flag).over(series())
    return x.withColumn("__b", before).where(F.col(flag) & ~F.col("__b")).drop("__b")


def first_per_uptrend(x: DataFrame, hit: Column) -> DataFrame:
    """The first hit of each stretch of rows at or above ma200."""
    up = F.coalesce(F.col("close") >= F.col("ma200"), F.lit(False))
    x = x.withColumn("__up", up).withColumn("__hit", F.coalesce(hit, F.lit(False)))
    x = x.withColumn("stretch", F.sum(F.when(F.col("__up"), 0).otherwise(1)).over(series().rowsBetween(W.unboundedPreceding, 0)))
    good = x.where("__up and __hit").withColumn("__r", F.row_number().over(W.partitionBy("symbol", "stretch").orderBy("date")))
    return good.where("__r = 1").drop("__r", "__up", "__hit")


TRIGGERS = ("ext200", "strength", "tsmom_pos", "tsmom_neg")


def sampled(x: DataFrame, cooldown: int = 63) -> DataFrame:
    """Rows with trigger columns -> trig, sampling and the rows of each sampling of each trigger: all (a cooldown apart),
    uptrend (one for each stretch above ma200) and cross (the first day the condition turns true)."""
    out = None
    for trig in TRIGGERS:
        hit = x.where(F.col(trig))
        every = hit.join(greedy_thin(hit, cooldown, ["symbol"]), ["symbol", "pos"])
        for name, rows in (("all", every), ("uptrend", first_per_uptrend(x, F.col(trig)).drop("stretch")), ("cross", crossed(x, trig))):
            part = rows.select(F.lit(trig).alias("trig"), F.lit(name).alias("sampling"), *x.columns)
            out = part if out is None else out.unionByName(part)
    return out


def study(bars: DataFrame, ext: float = 0.30, trail: float = 0.40, hi20: float = -0.02, strength: float = 0.30, ahead: int = 126) -> DataFrame:
    """The summary of every symbol, trigger and sampling; n is 0 where a study has no episode."""
    x = trigger_columns(indicators(bars), ext, trail, hi20, strength)
    x = x.withColumn("fwd", F.lead("close", ahead).over(series()) / F.col("close") - 1)
    x = x.withColumn("max_dd", F.min("close").over(series().rowsBetween(0, ahead)) / F.col("close") - 1)
    done = F.col("fwd").isNotNull()
    studies = F.array(*[F.struct(F.lit(t).alias("trig"), F.lit(s).alias("sampling")) for t in TRIGGERS for s in ("all", "uptrend", "cross")])
    g = sampled(x).groupBy("symbol", "trig", "sampling").agg(
        F.count(F.lit(1)).alias("n"), F.count("fwd").alias("n_complete"), F.percentile("fwd", 0.5).alias("median"), F.percentile(F.when(done, F.col("max_dd")), 0.5).alias("median_dd"),
        F.min(F.when(done, F.col("max_dd"))).alias("worst_dd"), F.try_divide(F.count(F.when(F.col("fwd") > 0, 1)).cast("double"), F.count("fwd")).alias("pct_positive"),
    )
    every = bars.select("symbol").distinct().withColumn("s", F.explode(studies)).select("symbol", "s.trig", "s.sampling")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.join(g, ["symbol", "trig", "sampling"], "left")
    return out.select("symbol", "trig", "sampling", zero("n"), zero("n_complete"), "median", "median_dd", "worst_dd", "pct_positive")


#: Dates that a claim names as its exceptions.
EXCEPTIONS = 4


def claims(episodes: DataFrame, dims: list[str], keys: list[str], least: int) -> DataFrame:
    """episodes (keys..., date, ret, dd, dims...) -> claims about every value of one dimension and of two.

    A claim: conditions, n, median, floor (worst return), worst_dd, consistency (the larger share of a sign),
    decades, exceptions (the first dates, EXCEPTIONS at most, whose sign is not the median's), searched (combinations
    tried, empty ones too) and its deflated confidence.
    """
    conj = [F.array(F.concat(F.lit(f"{d}="), F.col(d))) for d in dims]
    conj += [F.array(F.concat(F.lit(f"{a}="), F.col(a)), F.concat(F.lit(f"{b}="), F.col(b))) for i, a in enumerate(dims) for b in dims[i + 1 :]]
    e = episodes.where("ret is not null").withColumn("conditions", F.explode(F.array(*conj)))
    pos = F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    nth = F.row_number().over(W.partitionBy(*keys, "conditions", "loss").orderBy("date"))
    e = e.withColumn("loss", F.col("ret") < 0).withColumn("nth", nth)
    early = lambda loss: F.sort_array(F.collect_list(F.when((F.col("nth") <= EXCEPTIONS) & (F.col("loss") == loss), F.col("date"))))
    g = e.groupBy(*keys, "conditions").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("ret", 0.5).alias("median"), F.min("ret").alias("floor"), F.min("dd").alias("worst_dd"),
        F.greatest(pos, 1 - pos).alias("consistency"), F.count_distinct(F.floor(F.year("date") / 10)).alias("decades"),
        early(True).alias("losses"), early(False).alias("gains"),
    )
    g = g.withColumn("exceptions", F.when(F.col("median") >= 0, F.col("losses")).otherwise(F.col("gains"))).drop("losses", "gains")
    counts = episodes.where("ret is not null").groupBy(*keys).agg(*[F.count_distinct(d).alias(f"__{d}") for d in dims])
    one = sum((F.col(f"__{d}") for d in dims), F.lit(0))
    two = sum((F.col(f"__{a}") * F.col(f"__{b}") for i, a in enumerate(dims) for b in dims[i + 1 :]), F.lit(0))
    counts = counts.select(*keys, (one + two).alias("searched"))
    out = g.where(F.col("n") >= least).join(counts, keys)
    return out.withColumn("confidence", S.deflated_confidence(F.col("n"), F.col("consistency"), F.size("conditions"), F.col("decades"), F.col("searched")))
