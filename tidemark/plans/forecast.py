"""The forecast plan: feature frame, analogs, regime matches, ensemble, statistics, committee; and set-based replay.

Nothing loops over dates. Features and labels only look back, so a value at a row is the
same on the whole store and on one cut at any later row. Greedy thinning is stable under
cutting, so each regime prefix is thinned once and every query takes the kept positions
before it. What followed a position doesn't depend on the query; a query counts it if it
was complete by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.alignment import reindex_ffill
from tidemark.operators.regimes import UNKNOWN
from tidemark.operators.thinning import greedy_thin, thin_by_distance
from tidemark.operators.windows import n_bar_return, position, rolling, series
from tidemark.plans.analogs import nearest_earlier, scales, thin_nearest
from tidemark.plans.outcomes import forward_stats, horizon_stats
from tidemark.plans.technicals import rsi

FEATURES = [
    "ret_1d", "ret_5d", "ret_20d", "ret_60d", "ret_120d", "ret_252d", "rsi14", "ma50_dist", "ma200_dist", "drawdown_252", "rel_63", "vol_21",
    "leadership_spread", "leadership_age", "rank_pct",
]
GAP, LEAST, POOL, MOST = 20, 8, 120, 60
HORIZONS = (1, 5, 20, 60)
#: Of a forecast of the last row; the replay has only the first four.
LIVE_HORIZONS = (*HORIZONS, 126, 252)
MIN_ROWS = 260
DIMS = ("vix_label", "credit_label", "trend")


def feature_frame(bars: DataFrame, bench: DataFrame, context: DataFrame | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """symbol, date, pos, close and the 15 features.

    context (date, spread, age_weeks) and ranks (symbol, date, rank_pct) are carried forward on each
    symbol's calendar; where there is none, they are 0, 0 and a half, never null.
    """
    b = reindex_ffill(bars.select("symbol", "date", "close"), bench, "bench").withColumn("pos", position())
    for n, name in ((1, "ret_1d"), (5, "ret_5d"), (20, "ret_20d"), (60, "ret_60d"), (120, "ret_120d"), (252, "ret_252d")):
        b = b.withColumn(name, n_bar_return("close", n))
    b = rsi(b).withColumnRenamed("rsi_a", "rsi14").drop("rsi_b")
    for n in (50, 200):
        b = b.withColumn(f"ma{n}_dist", F.col("close") / rolling(F.avg, "close", n) - 1)
    b = b.withColumn("drawdown_252", F.col("close") / rolling(F.max, "close", 252) - 1)
    b = b.withColumn("rel_63", n_bar_return("close", 63) - n_bar_return("bench", 63))
    b = b.withColumn("vol_21", rolling(F.stddev_samp, "ret_1d", 21) * 252**0.5)
    carried = series().rowsBetween(W.unboundedPreceding, 0)
    if context is not None:
        b = b.join(context.select("date", F.col("spread").alias("leadership_spread"), F.col("age_weeks").alias("leadership_age")), "date", "left")
    if ranks is not None:
        b = b.join(ranks.select("symbol", "date", "rank_pct"), ["symbol", "date"], "left")
    for c, neutral in (("leadership_spread", 0.0), ("leadership_age", 0.0), ("rank_pct", 0.5)):
        b = b.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(carried), F.lit(neutral)) if c in b.columns else F.lit(neutral))
    return b


def regime_prefixes(regime_rows: DataFrame) -> DataFrame:
    """symbol, pos, depth, prefix for depth 3 to 0; a prefix with `unknown` matches nothing and is left out."""
    per = []
    for depth in (3, 2, 1, 0):
        known = F.lit(True)
        for d in DIMS[:depth]:
            known = known & (F.col(d) != UNKNOWN)
        prefix = F.concat_ws("/", *[F.col(d) for d in DIMS[:depth]]) if depth else F.lit("")
        per.append(F.when(known, F.struct(F.lit(depth).alias("depth"), prefix.alias("prefix"))))
    return regime_rows.withColumn("__p", F.explode(F.array(*per))).where("__p is not null").select("symbol", "pos", "__p.depth", "__p.prefix")


def regime_matches(regime_rows: DataFrame, queries: DataFrame, gap: int = GAP, least: int = LEAST, inclusive: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """symbol, query_pos, depth, pos: for each query the thinned positions before it (or up to it) that share its deepest
    regime prefix with at least `least` of them.

    queries: symbol, pos. candidates limits the positions (for example to drawdown days).
    """
    prefixes = regime_prefixes(regime_rows)
    pool = prefixes if candidates is None else prefixes.join(candidates.select("symbol", "pos"), ["symbol", "pos"], "left_semi")
    kept = greedy_thin(pool, gap, ["symbol", "depth", "prefix"])
    asked = prefixes.join(queries.select("symbol", "pos"), ["symbol", "pos"], "left_semi").withColumnRenamed("pos", "query_pos")
    before = (F.col("pos") <= F.col("query_pos")) if inclusive else (F.col("pos") < F.col("query_pos"))
    hits = asked.join(kept, ["symbol", "depth", "prefix"]).where(before)
    n = F.count(F.lit(1)).over(W.partitionBy("symbol", "query_pos", "depth"))
    hits = hits.withColumn("n", n).where(F.col("n") >= least)
    best = F.max("depth").over(W.partitionBy("symbol", "query_pos"))
    return hits.withColumn("best", best).where("depth = best").select("symbol", "query_pos", "depth", "pos")


def analog_matches(features: DataFrame, queries: DataFrame) -> DataFrame:
    """symbol, query_pos, kept (positions, nearest first), mean_dist: the nearest earlier rows, 20 rows apart.

    Distances are scaled by each feature's deviation up to and including the query; its mean cancels.
    Rows with a null feature are no candidates, and a query with one has no analogs.
    """
    x = scales(features, FEATURES, series()).withColumn("x", F.array(*[F.col(c) for c in FEATURES]))
    whole = F.forall("x", lambda v: v.isNotNull())
    x = x.where(whole).select("symbol", "pos", "x", "scale")
    asked = x.join(queries.select("symbol", "pos"), ["symbol", "pos"], "left_semi")
    near = nearest_earlier(x, asked, POOL, scaled=True, dims=len(FEATURES))
    return thin_nearest(near, GAP, MOST)


def matched_positions(features: DataFrame, regime_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """symbol, query_pos, mean_dist, model, pos: the positions that each model (analog, regime, ensemble) takes for a query.

    The ensemble keeps the analogs and adds, from the earliest, the regime's positions that are GAP rows from all kept ones.
    """
    analog = analog_matches(features, queries)
    regime = regime_matches(regime_rows, queries)
    none = F.array().cast("array<bigint>")
    matched = regime.groupBy("symbol", "query_pos").agg(F.sort_array(F.collect_list("pos")).alias("r"))
    both = analog.join(matched, ["symbol", "query_pos"], "full").withColumn("kept", F.coalesce("kept", none)).withColumn("r", F.coalesce("r", none))
    both = both.withColumn("all", thin_by_distance(F.col("r"), GAP, 1 << 30, F.col("kept")))
    # one row per query holds all three models' positions, so each search runs once
    model = lambda name, c: F.struct(F.lit(name).alias("model"), F.col(c).alias("at"))
    rows = both.select("symbol", "query_pos", "mean_dist", F.explode(F.array(model("analog", "kept"), model("regime", "r"), model("ensemble", "all"))).alias("m"))
    return rows.select("symbol", "query_pos", "mean_dist", "m.model", F.explode("m.at").alias("pos"))


def outcomes_of(matches: DataFrame, forward: DataFrame) -> DataFrame:
    """matches (symbol, query_pos, pos) with what followed each position, as far as it was complete by the query."""
    return matches.join(forward, ["symbol", "pos"]).where(F.col("pos") + F.col("h") <= F.col("query_pos"))


def forecast(
    bars: DataFrame, bench: DataFrame, regime_rows: DataFrame, queries: DataFrame, horizons=HORIZONS, context: DataFrame | None = None, ranks: DataFrame | None = None
) -> DataFrame:
    """One row per query, model (analog, regime, ensemble) and horizon: statistics, confidence and label.

    context and ranks as in feature_frame.
    """
    aligned = reindex_ffill(bars.select("symbol", "date", "close"), bench, "bench")
    forward = forward_stats(aligned, list(horizons), "bench").where("ret is not null")
    labels = regime_rows.select("symbol", "pos", F.concat_ws("/", *DIMS).alias("regime"))
    forward = forward.join(labels, ["symbol", "pos"])
    rows = matched_positions(feature_frame(bars, bench, context, ranks), regime_rows, queries)
    stats = horizon_stats(outcomes_of(rows, forward), ["symbol", "query_pos", "mean_dist", "model", "h"])
    asked = regime_rows.select("symbol", F.col("pos").alias("query_pos"), F.col("date").alias("as_of"), (F.concat_ws("/", *DIMS).contains(UNKNOWN)).alias("unknown"))
    stats = stats.join(asked, ["symbol", "query_pos"])
    shift, density = S.ood(F.col("mean_dist"), len(FEATURES))
    conc = S.is_concentrated(F.col("regimes"), F.col("date_start"), F.col("date_end"))
    by = W.partitionBy("symbol", "query_pos", "h")
    p_of = lambda m: F.max(F.when(F.col("model") == m, F.col("p_positive"))).over(by)
    stats = stats.withColumn("concentrated", conc).withColumn("__a", p_of("analog")).withColumn("__r", p_of("regime"))
    score = S.compute_confidence(F.col("n"), F.col("p_positive"), F.col("__a"), F.col("__r"), F.coalesce(density, F.lit(0.5)), F.col("unknown"), F.coalesce(shift, F.lit(False)), F.lit(False), F.col("concentrated"))
    stats = stats.withColumn("confidence", score).withColumn("confidence_label", S.forecast_confidence_label(F.col("confidence"), F.col("concentrated"))).drop("__a", "__r")
    return stats.withColumn("label", S.recommendation(F.col("n"), F.col("p_positive"), F.col("expected_mae"), F.col("confidence_label")))


def regime_replay(bars: DataFrame, bench: DataFrame, regime_rows: DataFrame, queries: DataFrame, horizons=HORIZONS) -> DataFrame:
    """symbol, query_pos, depth, h and statistics of the regime model, for every query at once."""
    aligned = reindex_ffill(bars.select("symbol", "date", "close"), bench, "bench")
    forward = forward_stats(aligned, list(horizons), "bench").where("ret is not null")
    forward = forward.join(regime_rows.select("symbol", "pos", F.concat_ws("/", *DIMS).alias("regime")), ["symbol", "pos"])
    matched = outcomes_of(regime_matches(regime_rows, queries), forward)
    return horizon_stats(matched, ["symbol", "query_pos", "depth", "h"])


def basis_horizon(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h: the horizon whose p_positive is furthest from a half, with 8 or more and a label that isn't low; ties: the shorter; else 5, else the first."""
    good = (F.col("n") >= LEAST) & (F.col("confidence_label") != "low")
    rank = F.when(good, F.abs(F.col("p_positive") - 0.5))
    best = F.max_by("h", F.when(good, F.struct(rank, -F.col("h"))))
    return stats.groupBy(*keys).agg(F.coalesce(best, F.max(F.when(F.col("h") == 5, F.lit(5))), F.min("h")).alias("h"))


def last_positions(regime_rows: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """symbol, pos of each symbol's last row, if it has enough rows."""
    return regime_rows.groupBy("symbol").agg(F.max("pos").alias("pos")).where(F.col("pos") + 1 >= least)


def replay_positions(regime_rows: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """symbol, pos of every row from the row floor on."""
    return regime_rows.where(F.col("pos") + 1 >= least).select("symbol", "pos")


def month_ends(regime_rows: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """symbol, pos of each month's last row from the row floor on."""
    return regime_rows.groupBy("symbol", F.trunc("date", "month")).agg(F.max("pos").alias("pos")).where(F.col("pos") + 1 >= least).select("symbol", "pos")


def dip_context(bars: DataFrame, bench: DataFrame, regime_rows: DataFrame, queries: DataFrame, threshold: float = -0.10, gap: int = 21, horizons=(21, 63)) -> DataFrame:
    """Queries in a drawdown: statistics of earlier drawdown days of the same regime, verdict. n_positions counts the current bar's own."""
    x = bars.select("symbol", "date", "close").withColumn("pos", position()).withColumn("dd", F.col("close") / rolling(F.max, "close", 252, 60) - 1)
    dips = x.where(F.col("dd") <= threshold)
    asked = queries.join(dips.select("symbol", "pos"), ["symbol", "pos"], "left_semi")
    matched = regime_matches(regime_rows, asked, gap, LEAST, inclusive=True, candidates=dips)
    count = matched.groupBy("symbol", "query_pos", "depth").agg(F.count(F.lit(1)).alias("n_positions"))
    aligned = reindex_ffill(bars.select("symbol", "date", "close"), bench, "bench")
    forward = forward_stats(aligned, list(horizons), "bench").where("ret is not null")
    forward = forward.join(regime_rows.select("symbol", "pos", F.concat_ws("/", *DIMS).alias("regime")), ["symbol", "pos"])
    stats = horizon_stats(outcomes_of(matched, forward), ["symbol", "query_pos", "depth", "h"]).join(count, ["symbol", "query_pos", "depth"])
    edge = F.col("p_positive") - 0.5
    return stats.withColumn("edge", edge).withColumn("verdict", S.dip_verdict(F.col("n"), edge, F.col("expected_mae"), F.lit(False)))


def ledger_rows(stats: DataFrame, dips: DataFrame, regime_rows: DataFrame, version: str) -> DataFrame:
    """Rows for the ledger of both voters: forecast_id, ticker, trading_date, horizon, voter, p_positive, label, evidence.

    stats: of the ensemble; dips: as dip_context gives them, whose verdict is the label. A row's id follows
    from its ticker, date, horizon, version and voter, so writing it again adds nothing.
    """
    dates = regime_rows.select("symbol", F.col("pos").alias("query_pos"), F.col("date").alias("as_of"))
    seen = F.to_json(F.struct("n", "p_positive", "q20", "q50", "q80", "expected_mae", "mean_excess"))
    own = stats.select("symbol", "as_of", "h", F.lit("ensemble").alias("voter"), "p_positive", "label", seen.alias("evidence"))
    gate = dips.join(dates, ["symbol", "query_pos"]).select("symbol", "as_of", "h", F.lit("dip_context").alias("voter"), "p_positive", F.col("verdict").alias("label"), seen.alias("evidence"))
    rows = own.unionByName(gate)
    rid = S.write_id("create_forecast", F.col("symbol"), F.date_format("as_of", "yyyy-MM-dd"), F.col("h"), F.lit(version), F.col("voter"))
    return rows.select(rid.alias("forecast_id"), F.col("symbol").alias("ticker"), F.col("as_of").alias("trading_date"), F.col("h").alias("horizon"), "voter", "p_positive", "label", "evidence")


def committee(ballots: DataFrame, keys: list[str], least_n: int = 8, least_families: int = 4) -> DataFrame:
    """ballots (keys..., voter, vote, confidence, independent_n, calibrated) -> convergence, disagreement, state.

    Uncalibrated voters weigh nothing and INSUFFICIENT_EVIDENCE abstains; mean and variance are weighted.
    """
    v = S.vote_value(F.col("vote"))
    b = ballots.withColumn("v", v).withColumn("w", F.when(F.col("calibrated") & v.isNotNull(), F.col("confidence")).otherwise(0.0))
    g = b.groupBy(*keys).agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("v")).alias("swv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("swvv"),
        F.count(F.when((F.col("w") > 0) & (F.col("independent_n") >= least_n), 1)).alias("families"),
    )
    mean = F.try_divide("swv", "sw")
    var = F.greatest(F.try_divide("swvv", "sw") - mean * mean, F.lit(0.0))
    g = g.withColumn("mean", mean).withColumn("disagreement", F.least(var, F.lit(1.0))).withColumn("convergence", 1 - F.col("disagreement"))
    state = F.when((F.col("families") < least_families) | F.col("mean").isNull(), "insufficient").when(F.col("convergence") >= 0.75, "agreement").when(F.col("convergence") >= 0.60, "mixed").otherwise("conflict")
    return g.withColumn("state", state).select(*keys, "families", "mean", "disagreement", "convergence", "state")


def score_outcomes(forecasts: DataFrame, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """forecasts (forecast_id, symbol, trading_date, h, p_positive, q20, q80) -> matured ones with ret, excess, mae, mfe, event, covered, brier, log_loss.

    The entry is the first bar on or after the trading date; a forecast is mature when h bars follow.
    """
    aligned = reindex_ffill(bars.select("symbol", "date", "close"), bench, "bench")
    entry = (
        forecasts.select("forecast_id", "symbol", F.col("trading_date").alias("date"), "h", "p_positive", "q20", "q80")
    )
    from tidemark.operators.alignment import first_on_or_after

    dated = first_on_or_after(entry, aligned.select("symbol", "date", F.col("date").alias("entry_date")), "entry_date", by=["symbol"])
    hs = [r[0] for r in forecasts.select("h").distinct().orderBy("h").collect()]  # one window each: horizons are a handful
    forward = forward_stats(aligned, hs, "bench").where("ret is not null").select("symbol", F.col("date").alias("entry_date"), "h", "ret", "mae", "mfe", "excess")
    j = dated.join(forward, ["symbol", "entry_date", "h"])
    hit = F.col("ret") > 0
    return j.select(
        "forecast_id", "symbol", "h", "entry_date", "ret", "excess", "mae", "mfe", hit.alias("event"), S.interval_covered(F.col("ret"), F.col("q20"), F.col("q80")).alias("covered"),
        S.brier(F.col("p_positive"), hit).alias("brier"), S.log_loss(F.col("p_positive"), hit).alias("log_loss"),
    )
