"""Studies over whole panels: scanner, rotation, extension overlay, deployment ladder, macro block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.alignment import asof_backward, reindex_ffill
from tidemark.operators.thinning import greedy_thin
from tidemark.operators.windows import n_bar_return, percent_rank_average, position, rolling, series
from tidemark.plans.outcomes import forward_paths
from tidemark.plans.technicals import rsi, tail_rank


def scanner_triggers(bars: DataFrame, bench: DataFrame, regime_rows: DataFrame) -> DataFrame:
    """symbol, triggers, qualifies: what is unusual about each symbol's last row; a regime change alone doesn't qualify."""
    x = reindex_ffill(bars, bench, "bench").withColumn("r1", n_bar_return("close", 1)).withColumn("back", tail_rank())
    x = rsi(x).withColumn("dd", F.col("close") / rolling(F.max, "close", 252) - 1).withColumn("rel63", n_bar_return("close", 63) - n_bar_return("bench", 63))
    rg = regime_rows.withColumn("t", F.concat_ws("/", "vix_label", "credit_label", "trend"))
    rg = rg.withColumn("moved", F.col("t") != F.lag("t", 5).over(series())).select("symbol", "date", "moved")
    everything = W.partitionBy("symbol")
    last = F.max_by("r1", F.when(F.col("r1").isNotNull(), F.col("date"))).over(everything)
    x = x.withColumn("cur", last).withColumn("share", F.avg(F.when(F.col("r1").isNull(), None).when(F.col("r1") <= F.col("cur"), 1.0).otherwise(0.0)).over(everything)).withColumn("k", F.count("r1").over(everything))
    x = x.where("back = 1").join(rg, ["symbol", "date"])
    flags = [
        ("return_percentile", (F.col("k") > 20) & (F.col("share") <= 0.05)), ("rsi_extreme", (F.col("rsi_a") <= 30) | (F.col("rsi_a") >= 70)),
        ("drawdown_threshold", F.col("dd") <= -0.15), ("relative_underperformance", F.col("rel63") <= -0.05), ("regime_transition", F.col("moved")),
    ]
    t = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))
    x = x.withColumn("triggers", t)
    return x.select("symbol", "date", "triggers", (F.size(F.array_remove("triggers", "regime_transition")) > 0).alias("qualifies"))


def scanner_digest(triggers: DataFrame, stats: DataFrame) -> DataFrame:
    """symbol, score, rk: qualifying symbols by opportunity, from their statistics (n, mean_excess, expected_mae, q20, q80)."""
    conf = F.least(F.lit(1.0), F.col("n") / 40.0)
    score = S.opportunity_score(F.col("mean_excess"), F.col("expected_mae"), F.col("q20"), F.col("q80"), F.lit(0.0), conf)
    x = triggers.where("qualifies").join(stats, "symbol").withColumn("score", score)
    return x.select("symbol", "score", F.row_number().over(W.orderBy(F.desc("score"), "symbol")).alias("rk"))  # a row per symbol


def gated_digest(triggers: DataFrame, forecasts: DataFrame, today, horizon: int = 5) -> DataFrame:
    """symbol, kind, reason, triggers, score, rk of symbols with a trigger of their own: skipped (no forecast, or none of
    today), gated_out (no reliable signal) or setup, which are ranked by opportunity.

    forecasts: the latest ensemble rows of each symbol (as_of, h, label, shift, confidence, statistics); the row of the
    horizon is read, or the shortest.
    """
    row = F.struct((F.col("h") != horizon).alias("other"), "h", *[c for c in forecasts.columns if c not in ("symbol", "h")])
    latest = forecasts.groupBy("symbol").agg(F.min_by(row, F.struct((F.col("h") != horizon).alias("o"), "h")).alias("f"))
    x = triggers.where("qualifies").select("symbol", "triggers").join(latest, "symbol", "left")
    reason = F.when(F.col("f").isNull(), "no_forecast_available").when(F.to_date("f.as_of") != today, "stale_forecast")
    x = x.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNotNull(), "skipped").when(F.col("f.label") == "no_reliable_signal", "gated_out").otherwise("setup"))
    f = lambda c: F.col(f"f.{c}")
    score = S.opportunity_score(f("mean_excess"), f("expected_mae"), f("q20"), f("q80"), F.coalesce(f("shift"), F.lit(False)).cast("double"), f("confidence"))
    x = x.withColumn("score", F.when(F.col("kind") == "setup", score))
    rk = F.when(F.col("kind") == "setup", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "symbol")))  # a row per symbol
    return x.select("symbol", "kind", "reason", "triggers", "score", rk.alias("rk"))


def rs_table(panel: DataFrame, bench: DataFrame, horizons=(21, 63, 126, 252)) -> DataFrame:
    """symbol, x21.., rk: excess returns of the last day in percent, by the three-month one (null last)."""
    x = reindex_ffill(panel.select("symbol", "date", "close"), bench, "bench")
    for h in horizons:
        x = x.withColumn(f"x{h}", (n_bar_return("close", h) - n_bar_return("bench", h)) * 100)
    x = x.withColumn("back", tail_rank()).where("back = 1")
    rk = F.row_number().over(W.orderBy(F.coalesce(F.col("x63"), F.lit(-999.0)).desc(), "symbol"))
    return x.select("symbol", *[f"x{h}" for h in horizons], rk.alias("rk"))


def rs_curves(panel: DataFrame, bench: DataFrame, tail: int = 252, step: int = 3) -> DataFrame:
    """symbol, date, rebased: the last rows' ratio to the benchmark from 100, every step-th."""
    x = reindex_ffill(panel.select("symbol", "date", "close"), bench, "bench").withColumn("back", tail_rank()).where(F.col("back") <= tail)
    ratio = F.col("close") / F.col("bench")
    w = series()
    x = x.withColumn("rebased", ratio / F.first(ratio).over(w) * 100).withColumn("i", F.row_number().over(w) - 1)
    return x.where(F.col("i") % step == 0).select("symbol", "date", "rebased")


def leader_runs(leaders: DataFrame, least: int = 10) -> DataFrame:
    """leader, start, stop, rows of leadership runs of enough rows, unknown left out."""
    from tidemark.operators.windows import with_runs

    x = with_runs(leaders.withColumn("symbol", F.lit("*")), "leader")
    g = x.where("leader <> 'unknown'").groupBy("run", "leader").agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.count(F.lit(1)).alias("rows"))
    return g.where(F.col("rows") >= least).drop("run")


def best_followers(panel: DataFrame, onsets: DataFrame, horizon: int = 63) -> DataFrame:
    """leader, symbol, times: for each kind of onset the symbol that did best most often over the next rows (the first seen on ties)."""
    fwd = panel.withColumn("fwd", F.lead("close", horizon).over(series()) / F.col("close") - 1).where("fwd is not null")
    at = onsets.select("leader", F.col("start").alias("date")).join(fwd.select("date", "symbol", "fwd"), "date")
    best = at.withColumn("r", F.row_number().over(W.partitionBy("leader", "date").orderBy(F.desc("fwd"), "symbol"))).where("r = 1")
    c = best.groupBy("leader", "symbol").agg(F.count(F.lit(1)).alias("times"), F.min("date").alias("seen"))
    return c.withColumn("r", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("times"), "seen"))).where("r = 1").select("leader", "symbol", "times")


def rotation_context(leaders: DataFrame) -> DataFrame:
    """date, spread, age_weeks: spread of the leader, and weeks since its run began (0 where unknown)."""
    from tidemark.operators.windows import with_runs

    x = with_runs(leaders.withColumn("symbol", F.lit("*")), "leader")
    days = F.datediff("date", F.min("date").over(W.partitionBy("run").orderBy("date"))) + 1
    return x.select("date", "spread", F.when(F.col("leader") == "unknown", 0.0).otherwise(days / 7).alias("age_weeks"))


def sector_ranks(panel: DataFrame, bench: DataFrame, n: int = 63) -> DataFrame:
    """symbol, date, rank_pct: percentile rank (average of ties, over the day's members) of the n-row return relative to the benchmark's."""
    base = bench.withColumn("symbol", F.lit("*")).select("date", n_bar_return("bench", n).alias("base"))
    rel = panel.withColumn("rel", n_bar_return("close", n)).join(base, "date").withColumn("rel", F.col("rel") - F.col("base"))
    return rel.select("symbol", "date", percent_rank_average("rel", "date").alias("rank_pct"))


def macro_block(macro: DataFrame, yoy_rows: int = 12) -> DataFrame:
    """series, value, change_91d, change_365d, yoy: the last value of each series, its change since the last value at or before
    91 and 365 days ago, and over so many rows."""
    w = W.partitionBy("series").orderBy("date")
    x = macro.withColumn("yoy", F.try_divide("value", F.lag("value", yoy_rows).over(w)) - 1).withColumn("r", F.row_number().over(W.partitionBy("series").orderBy(F.desc("date")))).where("r = 1")
    for n in (91, 365):
        ask = x.select("series", F.date_sub("date", n).alias("date"))
        old = asof_backward(ask, macro, "value", by=["series"], out="before").select("series", F.col("before").alias(f"b{n}"))
        x = x.join(old, "series").withColumn(f"change_{n}d", F.col("value") - F.col(f"b{n}"))
    return x.select("series", "date", "value", "change_91d", "change_365d", "yoy")


def overlay_episodes(bars: DataFrame, periods: DataFrame, ext: float = 0.30, trail: float = 0.40, cooldown: int = 21, horizon: int = 126) -> DataFrame:
    """symbol, date, pos, ext, trail, tag, fwd63, fwd126, max_dd, complete: thinned days that are far above their average after a rally."""
    from tidemark.plans.research import indicators, tag_periods

    x = indicators(bars)
    w = series()
    x = x.withColumn("fwd63", F.lead("close", 63).over(w) / F.col("close") - 1).withColumn("fwd126", F.lead("close", horizon).over(w) / F.col("close") - 1)
    x = x.withColumn("max_dd", F.min("close").over(w.rowsBetween(0, horizon)) / F.col("close") - 1)
    hit = x.where((F.col("ext") >= ext) & (F.col("trail126") >= trail))
    kept = greedy_thin(hit, cooldown, ["symbol"])
    e = hit.join(kept, ["symbol", "pos"]).select("symbol", "date", "pos", "ext", F.col("trail126").alias("trail"), "fwd63", "fwd126", "max_dd", F.col("fwd126").isNotNull().alias("complete"))
    return tag_periods(e, periods)


def cohort_stats(episodes: DataFrame, tags: list[str]) -> DataFrame:
    """tag -> n, n_complete, medians, worst, pct_positive; a row for each of the fixed tags."""
    spark = episodes.sparkSession
    done = lambda c: F.when(F.col("complete"), F.col(c))
    g = episodes.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("complete"), 1)).alias("n_complete"), F.percentile(done("fwd63"), 0.5).alias("median63"), F.percentile(done("fwd126"), 0.5).alias("median126"),
        F.min(done("max_dd")).alias("worst_dd"), F.count(F.when(F.col("complete") & (F.col("fwd126") > 0), 1)).alias("pos"),
    )
    fixed = spark.createDataFrame([(t,) for t in tags], "tag string")
    out = fixed.join(g, "tag", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("tag", zero("n"), zero("n_complete"), "median63", "median126", "worst_dd", F.try_divide(F.lit(100.0) * F.col("pos"), F.col("n_complete")).alias("pct_positive"))


def nearest_overlay(episodes: DataFrame, k: int = 3) -> DataFrame:
    """symbol, date, rk: the complete episodes nearest to each symbol's last one in extension and trailing return."""
    last = episodes.groupBy("symbol").agg(F.max(F.struct("pos", "ext", "trail")).alias("l"))
    x = episodes.where("complete").join(last, "symbol").where(F.col("pos") < F.col("l.pos"))
    dist = F.sqrt(F.pow((F.col("ext") - F.col("l.ext")) * 100, 2) + F.pow((F.col("trail") - F.col("l.trail")) * 100, 2))
    x = x.withColumn("dist", dist)
    return x.withColumn("rk", F.row_number().over(W.partitionBy("symbol").orderBy("dist", "date"))).where(F.col("rk") <= k).select("symbol", "date", "dist", "rk")


def merge_by_month(first: DataFrame, second: DataFrame) -> DataFrame:
    """first, and the episodes of second in months that first doesn't cover."""
    month = F.date_format("date", "yyyy-MM")
    seen = first.select(month.alias("m")).distinct()
    return first.unionByName(second.withColumn("m", month).join(seen, "m", "left_anti").drop("m"))


def deployment_ladder(last: DataFrame, events: DataFrame, rungs: list[tuple[float, float]], weekly: float, reserve: float, anchor_price: float, anchor_date: str, extension: int = 3) -> DataFrame:
    """last (symbol, date, close, high20, regime_break, credit, credit_jump) -> guardrails and the three tranches.

    events: date, note; a meeting noted SEP also blocks the days after it, up to the extension.
    """
    gap = F.datediff(F.col("day"), F.col("e"))
    ev = events.select(F.col("date").alias("e"), "note")
    dates = last.select(F.col("date").alias("day")).distinct()
    hit = dates.join(F.broadcast(ev), (gap == 0) | ((F.col("note") == "SEP") & gap.between(1, extension))).select("day").distinct().withColumn("black", F.lit(True))
    past = dates.join(F.broadcast(ev), F.col("e") <= F.col("day")).groupBy("day").agg(F.max("e").alias("last_event"))
    x = last.withColumn("day", F.col("date")).join(hit, "day", "left").join(past, "day", "left")
    blow = S.credit_blowout(F.col("credit"), F.col("credit_jump"))
    x = x.withColumn("blackout", F.coalesce("black", F.lit(False))).withColumn("blowout", blow).withColumn("blocked", F.col("blackout") | F.col("blowout"))
    x = x.withColumn("rebaseline", S.needs_rebaseline(F.col("close") / anchor_price - 1, F.datediff("date", F.lit(anchor_date).cast("date"))))
    ladder = F.array(*[F.struct(F.lit(a).alias("drawdown"), F.lit(b).alias("deploy")) for a, b in rungs])
    dd = F.col("close") / F.col("high20") - 1
    open_rungs = F.filter(ladder, lambda r: dd <= r["drawdown"])
    return x.select(
        "symbol", "date", "blackout", "blowout", "rebaseline", (F.col("last_event").isNotNull() & ~F.col("blocked")).alias("tranche1"),
        F.when(F.col("blocked") | F.col("high20").isNull(), 0).otherwise(F.size(open_rungs)).alias("rungs"), (F.col("regime_break") & ~F.col("blocked")).alias("tranche3"),
        F.lit(weekly).alias("weekly"), F.lit(reserve).alias("reserve"),
    )


def digest_json(rows: DataFrame, order: str) -> DataFrame:
    """One JSON document of all rows of a (small) digest."""
    return rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order])))).alias("json"))
