"""Queries: regime outcomes, analogs, replay, dip context, committee, scoring, ledger."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.alignment import reindex_ffill
from tidemark.operators.thinning import greedy_thin
from tidemark.operators.windows import position, rolling
from tidemark.plans import forecast as FC
from tidemark.plans import ledger as L
from tidemark.plans.outcomes import forward_paths, forward_stats, median_path
from tidemark.plans import studies as ST
from tidemark.plans.query_indicators import B, BE, CONTEXT_SQL, CR, LEADER_RUNS_SQL, P, REGIMES_SQL, SW, VX, _ewm_sql, _ma, inputs, nearest_first_sql, regime_bars, rotation, thin_sql
from tidemark.plans.registry import query
from tidemark.sources import market as M

# prefixes, thinned once each; forward outcomes on the benchmark-aligned calendar
_PREFIX = """pf AS (SELECT symbol, pos, 3 AS depth, vix_label || '/' || credit_label || '/' || trend AS prefix FROM rg WHERE vix_label <> 'unknown' AND credit_label <> 'unknown' AND trend <> 'unknown'
    UNION ALL SELECT symbol, pos, 2, vix_label || '/' || credit_label FROM rg WHERE vix_label <> 'unknown' AND credit_label <> 'unknown'
    UNION ALL SELECT symbol, pos, 1, vix_label FROM rg WHERE vix_label <> 'unknown' UNION ALL SELECT symbol, pos, 0, '' FROM rg)"""


def _forward_sql(hs) -> str:
    parts = " UNION ALL ".join(
        f"SELECT symbol, date, pos, {h} AS h, lead(close, {h}) OVER w / close - 1 AS ret, min(close) OVER f{h} / close - 1 AS mae, "
        f"lead(close, {h}) OVER w / close - lead(bench, {h}) OVER w / bench AS excess FROM al {SW}, f{h} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)"
        for h in hs
    )
    return f"""al AS (SELECT symbol, date, close, row_number() OVER w - 1 AS pos, last_value(bench IGNORE NULLS) OVER w AS bench FROM bars LEFT JOIN bench USING (date) {SW}),
      fw0 AS ({parts}), fw AS (SELECT f.*, vix_label || '/' || credit_label || '/' || trend AS regime FROM fw0 f JOIN rg USING (symbol, pos) WHERE ret IS NOT NULL)"""


_STATS = """count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p_positive, avg(CASE WHEN excess > 0 THEN 1.0 WHEN excess IS NOT NULL THEN 0.0 END) AS p_beat,
  quantile_cont(ret, 0.2) AS q20, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.8) AS q80, avg(mae) AS expected_mae, avg(excess) AS mean_excess,
  min(date) AS date_start, max(date) AS date_end, count(DISTINCT regime) AS regimes"""
_STAT_D = "p_positive p_beat q20 q50 q80 expected_mae mean_excess"


def _replay_sql(asked: str, hs) -> str:
    return f"""WITH RECURSIVE {REGIMES_SQL}, {_PREFIX}, {thin_sql('pf', 20, 'symbol, depth, prefix')}, {_forward_sql(hs)}, ask AS ({asked}),
      hit AS (SELECT a.symbol, a.pos AS query_pos, p.depth, k.pos FROM ask a JOIN pf p USING (symbol, pos) JOIN kept k ON k.symbol = p.symbol AND k.depth = p.depth AND k.prefix = p.prefix AND k.pos < a.pos),
      deep AS (SELECT symbol, query_pos, max(depth) AS depth FROM (SELECT symbol, query_pos, depth FROM hit GROUP BY ALL HAVING count(*) >= 8) GROUP BY ALL)
    SELECT symbol, query_pos, depth::INT AS depth, h::INT AS h, {_STATS} FROM hit JOIN deep USING (symbol, query_pos, depth) JOIN fw USING (symbol, pos)
    WHERE pos + h <= query_pos GROUP BY symbol, query_pos, depth, h"""


_LAST = "SELECT symbol, max(pos) AS pos FROM rg GROUP BY symbol HAVING max(pos) + 1 >= 260"
_MONTHS = "SELECT symbol, pos FROM (SELECT symbol, max(pos) AS pos FROM rg GROUP BY symbol, date_trunc('month', date)) WHERE pos + 1 >= 260"

_ALL = "SELECT symbol, pos FROM rg WHERE pos + 1 >= 260"


@query("flagship_regime_outcomes", _replay_sql(_LAST, (1, 5, 20, 60)), _STAT_D)
def flagship(spark, d):
    m, rg = inputs(spark, d)
    return FC.regime_replay(m.bars, m.bench, rg, FC.last_positions(rg))


@query("a01_j14_replay_month_ends", _replay_sql(_MONTHS, (5, 20, 60)), _STAT_D)
def replay_months(spark, d):
    m, rg = inputs(spark, d)
    return FC.regime_replay(m.bars, m.bench, rg, FC.month_ends(rg), (5, 20, 60))


@query("e20_full_replay_grid", _replay_sql("SELECT symbol, pos FROM rg WHERE pos + 1 >= 260", (20, 60)), _STAT_D)
def replay_grid(spark, d):
    m, rg = inputs(spark, d)
    return FC.regime_replay(m.bars, m.bench, rg, rg.where("pos + 1 >= 260").select("symbol", "pos"), (20, 60))


def _feat_sql(rel: str = "bars", context: bool = True, ranks: bool = False) -> str:
    """Relation fe: the 15 features of rel's rows; of relations cx (rotation context) and rr (ranks), where there are such."""
    carried = "OVER (PARTITION BY symbol ORDER BY date)"
    spread, age = (f"coalesce(last_value({c} IGNORE NULLS) {carried}, 0)" if context else "0.0::DOUBLE" for c in ("spread", "age_weeks"))
    rank = f"coalesce(last_value(rank_pct IGNORE NULLS) {carried}, 0.5)" if ranks else "0.5::DOUBLE"
    joins = (" LEFT JOIN cx USING (date)" if context else "") + (" LEFT JOIN rr USING (symbol, date)" if ranks else "")
    return f"""rd AS (SELECT symbol, date, close - lag(close) OVER w AS dd FROM {rel} {SW}), ry AS (SELECT symbol, date, greatest(dd, 0) AS up, greatest(-dd, 0) AS dn FROM rd WHERE dd IS NOT NULL),
  ru AS {_ewm_sql('up', 1 / 14, 'ry', 'symbol, date')}, rv AS {_ewm_sql('dn', 1 / 14, 'ry', 'symbol, date')},
  rs AS (SELECT symbol, date, CASE WHEN rv.y = 0 AND ru.y = 0 THEN NULL WHEN rv.y = 0 THEN 100 ELSE 100 - 100 / (1 + ru.y / rv.y) END AS rsi14 FROM ru JOIN rv USING (symbol, date)),
  fb AS (SELECT symbol, date, close, row_number() OVER w - 1 AS pos, last_value(bench IGNORE NULLS) OVER w AS bench, close / lag(close) OVER w - 1 AS ret_1d, rsi14,
    {spread}::DOUBLE AS leadership_spread, {age}::DOUBLE AS leadership_age, {rank}::DOUBLE AS rank_pct FROM {rel} LEFT JOIN bench USING (date) LEFT JOIN rs USING (symbol, date){joins} {SW}),
  fe AS (SELECT symbol, date, pos, ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d, close / lag(close, 20) OVER w - 1 AS ret_20d, close / lag(close, 60) OVER w - 1 AS ret_60d,
    close / lag(close, 120) OVER w - 1 AS ret_120d, close / lag(close, 252) OVER w - 1 AS ret_252d, rsi14, close / ({_ma(50)}) - 1 AS ma50_dist, close / ({_ma(200)}) - 1 AS ma200_dist,
    close / ({_ma(252, 'close', 'max')}) - 1 AS drawdown_252, (close / lag(close, 63) OVER w - 1) - (bench / lag(bench, 63) OVER w - 1) AS rel_63, ({_ma(21, 'ret_1d', 'stddev_samp')}) * sqrt(252) AS vol_21,
    leadership_spread, leadership_age, rank_pct FROM fb {SW})"""


_RANKS = """rl AS (SELECT symbol, date, (close / lag(close, 63) OVER w - 1) - base AS rel FROM panel JOIN br USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  rr AS (SELECT symbol, date, CASE WHEN rel IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY rel NULLS LAST) + (count(rel) OVER (PARTITION BY date, rel) - 1) / 2.0) / count(rel) OVER (PARTITION BY date) END AS rank_pct FROM rl)"""
_WITH_CONTEXT = f"WITH {B}, {LEADER_RUNS_SQL}, {CONTEXT_SQL}"

_DIST = " + ".join(f"pow((r.{c} - q.{c}) / q.s_{c}, 2)" for c in FC.FEATURES)
_SCALED = ", ".join(f"CASE WHEN coalesce(stddev_pop({c}) OVER e, 0) < 1e-12 THEN 1.0 ELSE stddev_pop({c}) OVER e END AS s_{c}" for c in FC.FEATURES)
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in FC.FEATURES)


def _positions_sql(asked: str) -> str:
    """Relation mp (symbol, query_pos, mean_dist, model, pos): what each model takes for the queries."""
    return f"""WITH RECURSIVE {REGIMES_SQL}, {_PREFIX}, {thin_sql('pf', 20, 'symbol, depth, prefix')}, ask AS ({asked}),
  {P}, {LEADER_RUNS_SQL.split(BE + ',', 1)[1]}, {CONTEXT_SQL}, {_feat_sql()},
  fz AS (SELECT *, {_SCALED} FROM fe WINDOW e AS (PARTITION BY symbol ORDER BY date)), whole AS (SELECT * FROM fz WHERE {_WHOLE}),
  pairs AS (SELECT q.symbol, q.pos AS query_pos, r.pos, sqrt({_DIST}) AS dist FROM whole q JOIN ask USING (symbol, pos) JOIN whole r ON r.symbol = q.symbol AND r.pos < q.pos),
  near AS (SELECT *, row_number() OVER (PARTITION BY symbol, query_pos ORDER BY dist, pos) AS rk FROM pairs QUALIFY rk <= 120),
  {nearest_first_sql('near', 'symbol, query_pos', 20, 60, 'analog')}, md AS (SELECT symbol, query_pos, avg(dist) AS mean_dist FROM near WHERE rk <= 20 GROUP BY ALL),
  hit AS (SELECT a.symbol, a.pos AS query_pos, p.depth, k.pos FROM ask a JOIN pf p USING (symbol, pos) JOIN kept k ON k.symbol = p.symbol AND k.depth = p.depth AND k.prefix = p.prefix AND k.pos < a.pos),
  deep AS (SELECT symbol, query_pos, max(depth) AS depth FROM (SELECT symbol, query_pos, depth FROM hit GROUP BY ALL HAVING count(*) >= 8) GROUP BY ALL),
  rp AS (SELECT symbol, query_pos, pos, row_number() OVER (PARTITION BY symbol, query_pos ORDER BY pos) AS i FROM hit JOIN deep USING (symbol, query_pos, depth)),
  grow AS (SELECT symbol, query_pos, 0::BIGINT AS i, coalesce(kept, []::BIGINT[]) AS taken FROM (SELECT DISTINCT symbol, query_pos FROM rp UNION SELECT symbol, query_pos FROM analog) LEFT JOIN analog USING (symbol, query_pos)
    UNION ALL SELECT g.symbol, g.query_pos, r.i, CASE WHEN len(list_filter(g.taken, lambda k: abs(k - r.pos) < 20)) = 0 THEN list_append(g.taken, r.pos) ELSE g.taken END
      FROM grow g JOIN rp r ON r.symbol = g.symbol AND r.query_pos = g.query_pos AND r.i = g.i + 1),
  ens AS (SELECT symbol, query_pos, arg_max(taken, i) AS taken FROM grow GROUP BY ALL),
  mp AS (SELECT symbol, query_pos, mean_dist, model, pos FROM (SELECT symbol, query_pos, 'analog' AS model, unnest(kept) AS pos FROM analog
    UNION ALL SELECT symbol, query_pos, 'regime', pos FROM rp UNION ALL SELECT symbol, query_pos, 'ensemble', unnest(taken) FROM ens) LEFT JOIN md USING (symbol, query_pos))"""


def _forecast_sql(asked: str, hs) -> str:
    """Relation fcast: the forecast's rows."""
    return f"""{_positions_sql(asked)}, {_forward_sql(hs)},
  st AS (SELECT symbol, query_pos, mean_dist, model, h::INT AS h, {_STATS} FROM mp JOIN fw USING (symbol, pos) WHERE pos + h <= query_pos GROUP BY ALL),
  s1 AS (SELECT st.*, rg.date AS as_of, vix_label = 'unknown' OR credit_label = 'unknown' OR trend = 'unknown' AS unknown, st.regimes < 2 OR date_end - date_start < 365 AS concentrated,
    max(p_positive) FILTER (model = 'analog') OVER m AS pa, max(p_positive) FILTER (model = 'regime') OVER m AS pr
    FROM st JOIN rg ON rg.symbol = st.symbol AND rg.pos = st.query_pos WINDOW m AS (PARTITION BY st.symbol, st.query_pos, st.h)),
  s2 AS (SELECT * EXCLUDE (pa, pr), greatest(0, least(100, round_even(100 * (least(1.0, n / 40.0) * greatest(p_positive, 1 - p_positive) * coalesce(1 - abs(pa - pr), 0.6)
      * coalesce(greatest(0.0, least(1.0, 1 - mean_dist / (2 * sqrt(15)))), 0.5))
    - 100 * (0.10 * unknown::INT + 0.15 * coalesce(mean_dist > sqrt(15), false)::INT + 0.20 * concentrated::INT), 0))) / 100 AS confidence FROM s1),
  s3 AS (SELECT *, CASE WHEN confidence >= 0.7 AND NOT concentrated THEN 'high' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'low' END AS confidence_label, coalesce(expected_mae, 0) AS deep FROM s2),
  fcast AS (SELECT * EXCLUDE (deep), CASE WHEN n < 8 OR confidence_label = 'low' THEN 'no_reliable_signal' WHEN abs(p_positive - 0.5) < 0.05 THEN 'hold_no_change'
    WHEN p_positive < 0.5 AND (p_positive <= 0.4 OR deep < -0.08) THEN 'reduce_defensive_candidate' WHEN p_positive < 0.5 THEN 'watch_for_confirmation'
    WHEN confidence_label = 'high' AND p_positive >= 0.62 AND deep > -0.08 THEN 'high_conviction_long_candidate' WHEN p_positive >= 0.55 THEN 'moderate_long_candidate'
    ELSE 'watch_for_confirmation' END AS label FROM s3)"""


_FORECAST_D = f"mean_dist {_STAT_D} confidence"


@query("t02_w11_s02_ensemble_positions", f"{_positions_sql(_LAST)} SELECT symbol, query_pos, model, pos FROM mp")
def ensemble_positions(spark, d):
    """The positions that analogs, regime and their union take for each symbol's last row."""
    m, rg = inputs(spark, d)
    rows = FC.matched_positions(FC.feature_frame(m.bars, m.bench, rotation(spark, d)), rg, FC.last_positions(rg))
    return rows.select("symbol", "query_pos", "model", "pos")


@query("e01_forecast", f"{_forecast_sql(_LAST, FC.LIVE_HORIZONS)} SELECT * FROM fcast", _FORECAST_D, places=4)
def forecast_query(spark, d):
    m, rg = inputs(spark, d)
    return FC.forecast(m.bars, m.bench, rg, FC.last_positions(rg), FC.LIVE_HORIZONS, context=rotation(spark, d))


@query("e20_forecast_month_ends", f"{_forecast_sql(_MONTHS, FC.HORIZONS)} SELECT * FROM fcast", _FORECAST_D, places=4)
def forecast_months(spark, d):
    """The whole forecast (analogs, regimes, ensemble) replayed for every symbol and month at once."""
    m, rg = inputs(spark, d)
    return FC.forecast(m.bars, m.bench, rg, FC.month_ends(rg), context=rotation(spark, d))


@query("e20_replay_forecasts", f"{_forecast_sql(_ALL, FC.HORIZONS)} SELECT * FROM fcast", _FORECAST_D, places=4)
def forecast_replay(spark, d):
    """The whole forecast replayed for every symbol and date."""
    m, rg = inputs(spark, d)
    return FC.forecast(m.bars, m.bench, rg, FC.replay_positions(rg), context=rotation(spark, d))


@query("e20_replay_regimes", _replay_sql(_ALL, FC.HORIZONS), _STAT_D)
def regime_replays(spark, d):
    m, rg = inputs(spark, d)
    return FC.regime_replay(m.bars, m.bench, rg, FC.replay_positions(rg))


_BASIS = """SELECT symbol, coalesce(arg_max(h, abs(p_positive - 0.5) * 1e6 - h) FILTER (n >= 8 AND confidence_label <> 'low'), max(h) FILTER (h = 5), min(h)) AS h FROM fcast WHERE model = 'ensemble' GROUP BY symbol"""


@query("t12_basis_horizon", f"{_forecast_sql(_LAST, FC.LIVE_HORIZONS)} {_BASIS}")
def basis(spark, d):
    m, rg = inputs(spark, d)
    stats = FC.forecast(m.bars, m.bench, rg, FC.last_positions(rg), FC.LIVE_HORIZONS, context=rotation(spark, d))
    return FC.basis_horizon(stats.where("model = 'ensemble'"), ["symbol"])


@query("p17_feature_frame", f"{_WITH_CONTEXT}, {_feat_sql()} SELECT * FROM fe", " ".join(FC.FEATURES), places=4)
def features(spark, d):
    return FC.feature_frame(M.daily_bars(spark, d), M.benchmark(spark, d), rotation(spark, d)).select("symbol", "date", "pos", *FC.FEATURES)


@query("p16_p17_ranked_features", f"{_WITH_CONTEXT}, {_RANKS}, {_feat_sql('panel', ranks=True)} SELECT * FROM fe", " ".join(FC.FEATURES), places=4)
def ranked_features(spark, d):
    """The members of the rotation universe, which have a rank."""
    panel, bench = M.panel_bars(spark, d), M.benchmark(spark, d)
    context = rotation(spark, d)
    return FC.feature_frame(panel, bench, context, ST.sector_ranks(panel, bench)).select("symbol", "date", "pos", *FC.FEATURES)


_SCALE = ", ".join(f"CASE WHEN coalesce(stddev_pop({c}) OVER e, 0) < 1e-12 THEN 1.0 ELSE stddev_pop({c}) OVER e END AS s_{c}" for c in FC.FEATURES)


@query("a17_expanding_scale", f"{_WITH_CONTEXT}, {_feat_sql()} SELECT symbol, date, {_SCALE} FROM fe WINDOW e AS (PARTITION BY symbol ORDER BY date)", " ".join(f"s_{c}" for c in FC.FEATURES), places=4)
def expanding_scale(spark, d):
    from tidemark.operators.windows import series
    from tidemark.plans.analogs import scales

    x = scales(FC.feature_frame(M.daily_bars(spark, d), M.benchmark(spark, d), rotation(spark, d)), FC.FEATURES, series())
    return x.select("symbol", "date", *[F.col("scale")[i].alias(f"s_{c}") for i, c in enumerate(FC.FEATURES)])


def _dip_sql(asked: str) -> str:
    return f"""WITH RECURSIVE {REGIMES_SQL}, {_PREFIX}, dp AS (SELECT symbol, pos FROM (SELECT symbol, row_number() OVER w - 1 AS pos, close / ({_ma(252, 'close', 'max', 60)}) - 1 AS dd FROM bars {SW}) WHERE dd <= -0.1),
      pd AS (SELECT pf.* FROM pf JOIN dp USING (symbol, pos)), {thin_sql('pd', 21, 'symbol, depth, prefix')}, {_forward_sql((21, 63))}, ask AS (SELECT m.* FROM ({asked}) m JOIN dp USING (symbol, pos)),
      hit AS (SELECT a.symbol, a.pos AS query_pos, p.depth, k.pos FROM ask a JOIN pf p USING (symbol, pos) JOIN kept k ON k.symbol = p.symbol AND k.depth = p.depth AND k.prefix = p.prefix AND k.pos <= a.pos),
      cnt AS (SELECT symbol, query_pos, depth, count(*) AS n_positions FROM hit GROUP BY ALL HAVING count(*) >= 8),
      deep AS (SELECT * FROM cnt QUALIFY depth = max(depth) OVER (PARTITION BY symbol, query_pos)),
      st AS (SELECT symbol, query_pos, depth::INT AS depth, h::INT AS h, any_value(n_positions) AS n_positions, {_STATS} FROM hit JOIN deep USING (symbol, query_pos, depth) JOIN fw USING (symbol, pos) WHERE pos + h <= query_pos GROUP BY symbol, query_pos, depth, h)
    SELECT *, p_positive - 0.5 AS edge, CASE WHEN n < 8 THEN 'INSUFFICIENT_EVIDENCE' WHEN p_positive - 0.5 <= -0.08 OR expected_mae < -0.12 THEN 'AVOID' WHEN p_positive - 0.5 >= 0.08 THEN 'BUY' ELSE 'WAIT' END AS verdict FROM st"""


@query("e02_dip_context", _dip_sql(_MONTHS), _STAT_D + " edge")
def dips(spark, d):
    m, rg = inputs(spark, d)
    return FC.dip_context(m.bars, m.bench, rg, FC.month_ends(rg))


@query("e20_replay_dips", _dip_sql(_ALL), _STAT_D + " edge")
def dip_replay(spark, d):
    """The dip voter replayed for every symbol and date."""
    m, rg = inputs(spark, d)
    return FC.dip_context(m.bars, m.bench, rg, FC.replay_positions(rg))


# ---- ledger: forecasts from the bars, one per symbol, month and horizon

FORECASTS_SQL = f"""{B}, {BE}, fc AS (
  SELECT symbol || '-' || strftime(date, '%Y%m%d') || '-' || h AS forecast_id, symbol, symbol AS ticker, date AS trading_date, h::INT AS h, h::INT AS horizon, (0.3 + 0.4 * (day(date) % 10) / 9.0)::DOUBLE AS p_positive,
    -0.02::DOUBLE AS q20, 0.03::DOUBLE AS q80, CASE WHEN day(date) % 3 = 0 THEN 'dip_context' ELSE 'ensemble' END AS voter, (day(date) * 3.25)::DOUBLE AS confidence,
    CASE WHEN day(date) % 2 = 0 THEN 'high' ELSE 'moderate' END AS label, date::TIMESTAMP AS as_of_ts
  FROM bars, (VALUES (5), (20)) t(h))"""


def forecasts(spark, d):
    h = F.explode(F.array(F.lit(5), F.lit(20)))
    f = M.daily_bars(spark, d).select("symbol", F.col("date").alias("trading_date"), h.alias("h"))
    day = F.dayofmonth("trading_date")
    return f.select(
        F.concat_ws("-", "symbol", F.date_format("trading_date", "yyyyMMdd"), F.col("h").cast("string")).alias("forecast_id"), "symbol", F.col("symbol").alias("ticker"), "trading_date", "h", F.col("h").alias("horizon"),
        (0.3 + 0.4 * (day % 10) / 9.0).alias("p_positive"), F.lit(-0.02).alias("q20"), F.lit(0.03).alias("q80"), F.when(day % 3 == 0, "dip_context").otherwise("ensemble").alias("voter"),
        (day * 3.25).alias("confidence"), F.when(day % 2 == 0, "high").otherwise("moderate").alias("label"), F.col("trading_date").cast("timestamp").alias("as_of_ts"),
    )


OUTCOMES_SQL = f"""al AS (SELECT symbol, date, close, last_value(bench IGNORE NULLS) OVER w AS bench FROM bars LEFT JOIN bench USING (date) {SW}),
  fa AS (SELECT symbol, date, 5 AS h, lead(close, 5) OVER w / close - 1 AS ret, min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) / close - 1 AS mae, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) / close - 1 AS mfe, lead(close, 5) OVER w / close - lead(bench, 5) OVER w / bench AS excess FROM al {SW}
    UNION ALL SELECT symbol, date, 20, lead(close, 20) OVER w / close - 1, min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) / close - 1, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) / close - 1, lead(close, 20) OVER w / close - lead(bench, 20) OVER w / bench FROM al {SW}),
  oc AS (SELECT forecast_id, fc.symbol, fc.h, date AS entry_date, ret, excess, mae, mfe, ret > 0 AS event, ret BETWEEN q20 AND q80 AS covered, pow(p_positive - (ret > 0)::INT, 2) AS brier,
    -CASE WHEN ret > 0 THEN ln(p_positive) ELSE ln(1 - p_positive) END AS log_loss FROM fc JOIN fa ON fa.symbol = fc.symbol AND fa.date = fc.trading_date AND fa.h = fc.h WHERE ret IS NOT NULL)"""


def outcomes(spark, d):
    return FC.score_outcomes(forecasts(spark, d), M.daily_bars(spark, d), M.benchmark(spark, d))


@query("e16_f15_outcome_scoring", f"WITH {FORECASTS_SQL}, {OUTCOMES_SQL} SELECT forecast_id, symbol, h, entry_date, ret, excess, mae, mfe, event, covered, brier, log_loss FROM oc", "ret excess mae mfe brier log_loss")
def scoring(spark, d):
    return outcomes(spark, d)


@query("j05_pending_outcomes", f"WITH {FORECASTS_SQL} SELECT forecast_id, ticker, trading_date, horizon FROM fc WHERE trading_date + horizon <= DATE '1999-01-01' AND NOT EXISTS (SELECT 1 FROM fc x WHERE x.forecast_id = fc.forecast_id AND day(x.trading_date) % 4 = 0)")
def pending(spark, d):
    f = forecasts(spark, d)
    done = f.where(F.dayofmonth("trading_date") % 4 == 0)
    return L.pending_outcomes(f, done, "1999-01-01").select("forecast_id", "ticker", "trading_date", "horizon")


@query("j06_unactioned", f"WITH {FORECASTS_SQL} SELECT forecast_id, voter FROM fc WHERE voter <> 'dip_context' AND day(trading_date) % 4 <> 0")
def unactioned(spark, d):
    f = forecasts(spark, d)
    return L.unactioned(f, f.where(F.dayofmonth("trading_date") % 4 == 0)).select("forecast_id", "voter")


@query("j07_a10_calibration", f"WITH {FORECASTS_SQL}, {OUTCOMES_SQL} SELECT ticker, horizon, label, count(*) AS n, avg(event::INT) AS hit_rate, avg(p_positive) AS stated, avg(brier) AS brier FROM fc JOIN oc USING (forecast_id) GROUP BY ALL", "hit_rate stated brier")
def calibration(spark, d):
    return L.calibration(forecasts(spark, d), outcomes(spark, d).select("forecast_id", "ret"))


@query("a11_calibration_buckets", f"WITH {FORECASTS_SQL}, {OUTCOMES_SQL} SELECT CASE WHEN confidence >= 100 THEN 6 ELSE floor(confidence / 20) + 1 END::INT AS bucket, count(*) AS n, avg(event::INT) AS hit_rate FROM fc JOIN oc USING (forecast_id) GROUP BY 1", "hit_rate")
def buckets(spark, d):
    return L.calibration_buckets(forecasts(spark, d), outcomes(spark, d).select("forecast_id", "ret"))


@query("a09_block_counts", f"WITH {FORECASTS_SQL} SELECT voter, horizon, count(*) AS n FROM fc WHERE horizon IN (1, 5, 20, 60, 21, 63) GROUP BY ALL")
def counts(spark, d):
    return L.block_counts(forecasts(spark, d))


@query("t09_latest_batch", f"WITH {FORECASTS_SQL} SELECT forecast_id, ticker FROM fc QUALIFY rank() OVER (PARTITION BY ticker ORDER BY as_of_ts DESC) = 1")
def latest(spark, d):
    return L.latest_batch(forecasts(spark, d)).select("forecast_id", "ticker")


@query("t10_t11_listings", f"WITH {FORECASTS_SQL} (SELECT forecast_id, 'oldest' AS kind FROM fc ORDER BY as_of_ts, forecast_id LIMIT 500) UNION ALL (SELECT forecast_id, 'newest' FROM fc ORDER BY as_of_ts DESC, forecast_id LIMIT 200)")
def listings(spark, d):
    f = forecasts(spark, d)
    old = f.orderBy("as_of_ts", "forecast_id").limit(500).select("forecast_id", F.lit("oldest").alias("kind"))
    return old.unionByName(f.orderBy(F.desc("as_of_ts"), "forecast_id").limit(200).select("forecast_id", F.lit("newest").alias("kind")))


@query(
    "j08_j09_nested_decisions",
    f"""WITH {FORECASTS_SQL}, {OUTCOMES_SQL}, dc AS (SELECT 'D' || forecast_id AS decision_id, forecast_id, CASE WHEN h = 5 THEN 'BUY' ELSE 'WAIT' END AS action FROM fc)
    SELECT decision_id, action, ticker, count(oc.forecast_id) AS n_outcomes, max(ret) AS ret FROM dc JOIN fc USING (forecast_id) LEFT JOIN oc USING (forecast_id) GROUP BY ALL""",
    "ret",
)
def nested(spark, d):
    f = forecasts(spark, d)
    dec = f.select(F.concat(F.lit("D"), "forecast_id").alias("decision_id"), "forecast_id", F.when(F.col("h") == 5, "BUY").otherwise("WAIT").alias("action"))
    out = outcomes(spark, d).select("forecast_id", "ret", F.col("entry_date").alias("evaluated_at"))
    n = L.nested_decisions(dec, f, out)
    per = F.col("forecast.outcomes")
    return n.select("decision_id", "action", F.col("forecast.ticker").alias("ticker"), F.greatest(F.coalesce(F.size(per), F.lit(0)), F.lit(0)).cast("long").alias("n_outcomes"), F.element_at(F.transform(per, lambda o: o["ret"]), 1).alias("ret"))


@query(
    "j10_lookup_bundle",
    f"""WITH {FORECASTS_SQL}, {OUTCOMES_SQL} SELECT f.forecast_id, f.p_positive, f.label, arg_max(oc.ret, oc.entry_date) AS latest_ret FROM fc f LEFT JOIN oc USING (forecast_id) GROUP BY ALL""",
    "p_positive latest_ret",
)
def bundle(spark, d):
    f = forecasts(spark, d)
    o = outcomes(spark, d).groupBy("forecast_id").agg(F.max_by("ret", "entry_date").alias("latest_ret"))
    return f.join(o, "forecast_id", "left").select("forecast_id", "p_positive", "label", "latest_ret")


@query(
    "j11_s05_episode_library",
    f"""WITH {B}, lib AS (SELECT symbol AS asset, date AS event_date, 'cause ' || day(date) AS cause FROM bars WHERE day(date) = 15), ev AS (SELECT symbol, date FROM bars)
    SELECT symbol, date, cause, cause IS NOT NULL AS annotated FROM ev LEFT JOIN lib ON asset = symbol AND event_date = date""",
)
def library(spark, d):
    from tidemark.plans.engines import annotate_episodes

    b = M.daily_bars(spark, d).select("symbol", "date")
    lib = b.where(F.dayofmonth("date") == 15).select(F.col("symbol").alias("asset"), F.col("date").alias("event_date"), F.concat(F.lit("cause "), F.dayofmonth("date").cast("string")).alias("cause"))
    return annotate_episodes(b, lib).select("symbol", "date", "cause", "annotated")


@query("j16_backfill_dates", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END, DATE '1990-01-01') AS trading_date, date_diff('day', coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END, DATE '1990-01-01'), o_orderdate::DATE)::INT AS drift_days FROM orders")
def backfill(spark, d):
    o = M.table(spark, d, "orders")
    snap = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.to_date("o_orderdate").alias("provider_date"))
    j = o.select("o_orderkey", F.to_date("o_orderdate").alias("as_of")).join(snap, "o_orderkey", "left")
    day = F.coalesce("provider_date", F.lit("1990-01-01").cast("date"))
    return j.select("o_orderkey", day.alias("trading_date"), F.datediff("as_of", day).alias("drift_days"))


@query("a22_e10_committee", f"""WITH v AS (SELECT c_custkey, n, CASE (c_custkey * n) % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'AVOID' WHEN 2 THEN 'WAIT' ELSE 'INSUFFICIENT_EVIDENCE' END AS vote, (0.2 + (c_custkey % 7) / 10.0)::DOUBLE AS conf, 6 + (c_custkey + n) % 5 AS k, (c_custkey + n) % 6 <> 0 AS cal FROM customer, range(1, 7) t(n)),
      x AS (SELECT c_custkey, CASE vote WHEN 'BUY' THEN 1.0 WHEN 'AVOID' THEN -1.0 WHEN 'WAIT' THEN 0.0 END AS v, CASE WHEN cal AND vote <> 'INSUFFICIENT_EVIDENCE' THEN conf ELSE 0 END AS w, k FROM v),
      g AS (SELECT c_custkey, count(*) FILTER (w > 0 AND k >= 8) AS families, sum(w) AS sw, sum(w * v) AS swv, sum(w * v * v) AS swvv FROM x GROUP BY c_custkey),
      m AS (SELECT c_custkey, families, swv / nullif(sw, 0) AS mean, least(greatest(swvv / nullif(sw, 0) - (swv / nullif(sw, 0)) * (swv / nullif(sw, 0)), 0), 1.0) AS dis FROM g)
    SELECT c_custkey, families, mean, CASE WHEN mean IS NOT NULL THEN dis END AS disagreement, CASE WHEN mean IS NOT NULL THEN 1 - dis END AS convergence, CASE WHEN families < 4 OR mean IS NULL THEN 'insufficient' WHEN round(1 - dis, 9) >= 0.75 THEN 'agreement' WHEN round(1 - dis, 9) >= 0.60 THEN 'mixed' ELSE 'conflict' END AS state FROM m""", "mean disagreement convergence")
def committee(spark, d):
    n = F.explode(F.sequence(F.lit(1), F.lit(6)))
    v = M.table(spark, d, "customer").select("c_custkey", n.alias("n"))
    kind = (F.col("c_custkey") * F.col("n")) % 4
    b = v.select(
        "c_custkey", F.col("n").alias("voter"), F.when(kind == 0, "BUY").when(kind == 1, "AVOID").when(kind == 2, "WAIT").otherwise("INSUFFICIENT_EVIDENCE").alias("vote"),
        (0.2 + (F.col("c_custkey") % 7) / 10.0).alias("confidence"), (6 + (F.col("c_custkey") + F.col("n")) % 5).alias("independent_n"), ((F.col("c_custkey") + F.col("n")) % 6 != 0).alias("calibrated"),
    )
    return FC.committee(b, ["c_custkey"])


@query("a23_gap_detector", f"WITH {FORECASTS_SQL}, g AS (SELECT symbol AS ticker, h FROM (SELECT DISTINCT symbol FROM bars), (VALUES (1), (5), (20)) t(h)) SELECT ticker, h FROM g WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.ticker = g.ticker AND fc.h = g.h)")
def gaps(spark, d):
    f = forecasts(spark, d)
    grid = M.daily_bars(spark, d).select(F.col("symbol").alias("ticker")).distinct().withColumn("h", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))))
    return grid.join(f.select("ticker", "h").distinct(), ["ticker", "h"], "left_anti")


@query("a05_median_path", f"""WITH {B}, x AS (SELECT symbol, date, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING) AS l FROM bars),
      p AS (SELECT symbol, list_transform(list_filter(l, lambda v, i: (i - 1) % 5 = 0), lambda v: v / l[1] * 100) AS p FROM x WHERE len(l) = 61)
    SELECT symbol, idx::INT AS idx, quantile_cont(v, 0.5) AS median FROM (SELECT symbol, unnest(p) AS v, unnest(range(len(p))) AS idx FROM p) GROUP BY symbol, idx""", "median", places=4)
def medians(spark, d):
    p = forward_paths(M.daily_bars(spark, d), 60, 5).where("n = 61")
    return median_path(p.select("symbol", "path"), "symbol")


@query("f24_json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_paths(spark, d):
    return M.table(spark, d, "events").select("event_id", L.thin_payload(F.col("props"), "$.k").alias("k"))
