"""Queries: technical engines, studies, scalar functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.windows import position, rolling, series
from tidemark.plans import engines as E
from tidemark.plans import forecast as FC
from tidemark.plans import intraday as I
from tidemark.plans import research as R
from tidemark.plans import studies as ST
from tidemark.plans import technicals as T
from tidemark.plans import validation as V
from tidemark.plans.query_forecast import _FORECAST_D, _LAST, _dip_sql, _forecast_sql, _replay_sql
from tidemark.plans.query_indicators import B, BE, CONTEXT_SQL, CR, IN, LEADER_RUNS_SQL as _LRUN, P, REGIMES_SQL, SW, TAGS, _ewm_sql, _ma, _TAGS, inputs, leaders, regime_bars, rotation, thin_sql
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.sources import market as M

_TAIL = "row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back"


@query(
    "a12_volume_regime",
    f"""WITH {B}, x AS (SELECT *, {_TAIL} FROM bars), g AS (SELECT symbol, avg(volume) FILTER (close >= open) / avg(volume) AS up_rel, avg(volume) FILTER (close < open) / avg(volume) AS down_rel FROM x WHERE back <= 20 GROUP BY symbol)
    SELECT *, CASE WHEN up_rel >= 1.15 * down_rel AND up_rel >= 1 THEN 'accumulation' WHEN down_rel >= 1.15 * up_rel AND down_rel >= 1 THEN 'distribution' ELSE 'balanced' END AS signature FROM g""",
    "up_rel down_rel",
)
def volume_regime(spark, d):
    return T.volume_regime(M.daily_bars(spark, d))


@query(
    "a13_down_volume",
    f"""WITH {B}, x AS (SELECT symbol, volume, close < lag(close) OVER (PARTITION BY symbol ORDER BY date) AS down, {_TAIL} FROM bars),
      g AS (SELECT symbol, avg(volume) FILTER (back <= 10 AND down) / avg(volume) FILTER (back BETWEEN 11 AND 63) AS ratio FROM x GROUP BY symbol)
    SELECT symbol, ratio, CASE WHEN ratio >= 1.3 THEN 'capitulation' WHEN ratio <= 0.8 THEN 'distribution' WHEN ratio IS NOT NULL THEN 'neutral' END AS label FROM g""",
    "ratio",
)
def forensics(spark, d):
    return T.down_day_forensics(M.daily_bars(spark, d))


@query(
    "a14_down_volume_ratio",
    f"""WITH {B}, x AS (SELECT symbol, volume, close < lag(close) OVER (PARTITION BY symbol ORDER BY date) AS down, count(*) OVER (PARTITION BY symbol) AS n, {_TAIL} FROM bars)
    SELECT symbol, avg(volume) FILTER (back <= 10 AND down) / nullif(avg(volume) FILTER (back BETWEEN 11 AND 60), 0) AS ratio FROM x WHERE n >= 60 GROUP BY symbol""",
    "ratio",
)
def down_ratio(spark, d):
    return T.down_volume_ratio(M.daily_bars(spark, d))


@query(
    "a15_up_down_volume",
    f"""WITH {B}, x AS (SELECT symbol, date, volume, close - lag(close) OVER w AS dd FROM bars {SW}),
      y AS (SELECT symbol, date, CASE WHEN count(dd) OVER q >= 10 AND sum(volume) FILTER (dd < 0) OVER q > 0 THEN coalesce(sum(volume) FILTER (dd >= 0) OVER q, 0) / sum(volume) FILTER (dd < 0) OVER q END AS ratio FROM x WINDOW q AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING))
    SELECT symbol, date, ratio, lag(ratio, 5) OVER w AS ratio_5_ago FROM y {SW}""",
    "ratio ratio_5_ago",
)
def up_down(spark, d):
    return T.up_down_volume(M.daily_bars(spark, d))


@query(
    "a16_t04_volume_shelves",
    f"""WITH {B}, x AS (SELECT * FROM (SELECT *, {_TAIL} FROM bars) WHERE back <= 90), s AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM x GROUP BY symbol),
      y AS (SELECT x.symbol, volume, greatest(0, least(23, floor((CASE WHEN high > low THEN low ELSE close END - lo) / ((hi - lo) / 24))))::INT AS a, greatest(0, least(23, floor((CASE WHEN high > low THEN high ELSE close END - lo) / ((hi - lo) / 24))))::INT AS b FROM x JOIN s USING (symbol)),
      h AS (SELECT symbol, bin, sum(volume / (b - a + 1)) AS v FROM (SELECT *, unnest(range(a, b + 1)) AS bin FROM y) GROUP BY ALL),
      f AS (SELECT s.symbol, g.bin::INT AS bin, lo, hi, coalesce(v, 0) AS v FROM s CROSS JOIN range(24) g(bin) LEFT JOIN h ON h.symbol = s.symbol AND h.bin = g.bin)
    SELECT symbol, bin, lo + (bin + 0.5) * ((hi - lo) / 24) AS price, v / sum(v) OVER (PARTITION BY symbol) AS share, round(v, 6) >= round(quantile_cont(v, 0.8) OVER (PARTITION BY symbol), 6) AND v > 0 AS is_shelf,
      row_number() OVER (PARTITION BY symbol ORDER BY v DESC, bin)::INT AS rk FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY v DESC, bin) <= 3""",
    "price share",
    places=4,
)
def shelves(spark, d):
    return T.volume_shelves(M.daily_bars(spark, d)).where("rk <= 3")


@query(
    "w26_reclaim",
    f"""WITH {B}, x AS (SELECT symbol, date, volume, coalesce(close >= ({_ma(50)}), false) AS up, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS v50, {_TAIL} FROM bars),
      y AS (SELECT *, up AND NOT coalesce(lag(up) OVER w, true) AS crossed FROM x WHERE back <= 13 {SW}),
      g AS (SELECT symbol, arg_max(up, back) AS first_up, arg_min(up, back) AS last_up, min(back) FILTER (crossed) AS at_, arg_min(volume, back) FILTER (crossed) AS v, arg_min(v50, back) FILTER (crossed) AS v50 FROM y GROUP BY symbol)
    SELECT symbol, NOT first_up AND last_up AND at_ IS NOT NULL AS reclaimed, NOT first_up AND last_up AND at_ IS NOT NULL AND coalesce(v >= v50, true) AS strong FROM g""",
)
def reclaims(spark, d):
    return T.reclaim(M.daily_bars(spark, d))


_IND = f"""dl AS (SELECT symbol, date, close - lag(close) OVER w AS dd FROM bars {SW}), dz AS (SELECT symbol, date, greatest(dd, 0) AS up, greatest(-dd, 0) AS dn FROM dl WHERE dd IS NOT NULL),
  ru AS {_ewm_sql('up', 1 / 14, 'dz', 'symbol, date')}, rd AS {_ewm_sql('dn', 1 / 14, 'dz', 'symbol, date')}, mf AS {_ewm_sql('close', 2 / 13, 'bars', 'symbol, date')}, ms AS {_ewm_sql('close', 2 / 27, 'bars', 'symbol, date')},
  mm AS (SELECT mf.symbol, mf.date, mf.y - ms.y AS macd FROM mf JOIN ms ON mf.symbol = ms.symbol AND mf.date = ms.date), mg AS {_ewm_sql('macd', 2 / 10, 'mm', 'symbol, date, macd')},
  tr AS (SELECT symbol, date, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {SW}), at_ AS {_ewm_sql('tr', 1 / 14, 'tr', 'symbol, date')}"""


@query(
    "e03_e06_technical_read",
    f"""WITH {B}, {_IND}, x AS (SELECT b.symbol, b.date, close, 100 - 100 / (1 + ru.y / rd.y) AS rsi, macd - mg.y AS histogram, at_.y AS atr, {_ma(50)} AS ma50, {_ma(200)} AS ma200, {_ma(50, 'high', 'max')} AS res50, {_ma(50, 'low', 'min')} AS sup50
        FROM (SELECT * FROM bars) b LEFT JOIN ru USING (symbol, date) LEFT JOIN rd USING (symbol, date) LEFT JOIN mg USING (symbol, date) LEFT JOIN at_ USING (symbol, date)),
      y AS (SELECT *, histogram > lag(histogram) OVER w AS macd_rising, close > lag(close, 39) OVER w AND rsi < lag(rsi, 39) OVER w AND rsi < 60 AS divergence, {_TAIL} FROM x {SW}),
      z AS (SELECT *, CASE WHEN close >= ma50 AND close >= ma200 AND ma50 >= ma200 THEN 'uptrend' WHEN close < ma50 AND close < ma200 AND ma50 < ma200 THEN 'downtrend' ELSE 'mixed' END AS trend FROM y WHERE back = 1)
    SELECT symbol, date, close, trend, rsi AS rsi_a, rsi AS rsi_b, histogram, macd_rising, divergence, atr, res50, sup50, CASE trend WHEN 'uptrend' THEN 'BUY' WHEN 'downtrend' THEN 'AVOID' ELSE 'WAIT' END AS vote FROM z""",
    "close rsi_a rsi_b histogram atr res50 sup50",
    places=2,
)
def read(spark, d):
    return T.technical_read(M.daily_bars(spark, d))


@query(
    "w27_flush_gate",
    f"""WITH {IN}, rg AS (SELECT symbol, avg(high - low) / 4 AS atr FROM intraday GROUP BY symbol),
      x AS (SELECT i.*, atr, sum(close * volume) OVER r / sum(volume) OVER r AS vwap, row_number() OVER r AS i, count(*) OVER s AS n, avg(volume) OVER s AS mean FROM intraday i JOIN rg USING (symbol) WINDOW r AS (PARTITION BY symbol, session ORDER BY bar_ts), s AS (PARTITION BY symbol, session)),
      y AS (SELECT *, min(CASE WHEN high - low > 2 * atr AND volume > 2 * mean THEN i END) OVER (PARTITION BY symbol, session) AS f FROM x WHERE n >= 6),
      g AS (SELECT symbol, session, any_value(f) AS f, any_value(n) AS n, min(low) FILTER (i = f) AS fl, min(low) FILTER (i > f AND i <= f + 4) AS al, arg_max(close, i) AS c, arg_max(vwap, i) AS vw, arg_max(volume, i) AS v, max(close) FILTER (i = n - 1) AS cb, max(volume) FILTER (i = n - 1) AS vb FROM y GROUP BY symbol, session),
      h AS (SELECT symbol, session, f IS NOT NULL AS flush, coalesce(n - f >= 4 AND al >= fl, false) AS stall, coalesce(n - f >= 1 AND round(c - vw, 9) > 0, false) AS reclaimed, coalesce(n - f >= 2 AND v > vb AND c > cb, false) AS up FROM g)
    SELECT symbol, session, flush, stall, reclaimed, reclaimed AND up AS strong, CASE WHEN reclaimed THEN 'reclaim' WHEN stall THEN 'stall' WHEN flush THEN 'flush' ELSE 'none' END AS stage FROM h""",
)
def flush(spark, d):
    bars = M.intraday_bars(spark, d)
    return I.flush_reclaim(bars, bars.groupBy("symbol").agg((F.avg(F.col("high") - F.col("low")) / 4).alias("atr")))


_INB = "ib AS (SELECT *, bar_ts AS date FROM intraday WHERE bar_ts + INTERVAL 15 minutes <= TIMESTAMP '2024-01-20 10:07:00')"


@query(
    "e18_e24_reclaim_gate",
    f"""WITH {IN}, {_INB}, mf AS {_ewm_sql('close', 2 / 13, 'ib', 'symbol, date')}, ms AS {_ewm_sql('close', 2 / 27, 'ib', 'symbol, date')}, mm AS (SELECT mf.symbol, mf.date, mf.y - ms.y AS macd FROM mf JOIN ms ON mf.symbol = ms.symbol AND mf.date = ms.date),
      mg AS {_ewm_sql('macd', 2 / 10, 'mm', 'symbol, date, macd')}, x AS (SELECT symbol, date, close, volume, sum((high + low + close) / 3 * volume) OVER (PARTITION BY symbol, session ORDER BY date) / sum(volume) OVER (PARTITION BY symbol, session ORDER BY date) AS vwap, lag(volume) OVER (PARTITION BY symbol ORDER BY date) AS before, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM ib)
    SELECT x.symbol, x.date AS bar_ts, coalesce(close > vwap AND volume >= before AND macd - mg.y > 0, false) AS open FROM x JOIN mg ON mg.symbol = x.symbol AND mg.date = x.date WHERE back = 1""",
)
def gate(spark, d):
    return I.reclaim_gate(M.intraday_bars(spark, d), "2024-01-20 10:07:00").withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))


@query(
    "e24_gate_batch",
    f"""WITH gate AS ({ORACLE_SQL['e18_e24_reclaim_gate']}), s AS (SELECT event_type AS symbol, count(*) AS score FROM events GROUP BY 1 UNION ALL SELECT 'without bars', 1000000000000),
      t AS (SELECT symbol, row_number() OVER (ORDER BY score DESC, symbol)::INT AS rk FROM s)
    SELECT t.symbol, rk, CASE WHEN open THEN 'GO' ELSE 'NO-GO' END AS verdict, CASE WHEN open IS NULL THEN 'no_closed_bars' END AS warning FROM t LEFT JOIN gate ON gate.symbol = t.symbol WHERE rk <= 5""",
)
def batch(spark, d):
    """The gates of the five most frequent event types, one of which is invented and has no bars."""
    setups = M.table(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("score"))
    setups = setups.unionByName(spark.sql("SELECT 'without bars' AS symbol, 1000000000000L AS score"))
    return I.gate_batch(setups, M.intraday_bars(spark, d), "2024-01-20 10:07:00")


RS_SQL = f"""{B}, {BE}, j AS (SELECT symbol, date, ln(close) - ln(bench) AS rel FROM bars JOIN bench USING (date)),
  x AS ({' UNION ALL '.join(f"SELECT symbol, date, {n} AS win, rel - lag(rel, {n}) OVER w AS r FROM j {SW}" for n in (5, 10, 20, 40, 63, 126))}),
  c AS (SELECT *, arg_max(r, date) OVER (PARTITION BY symbol, win) AS cur FROM x WHERE r IS NOT NULL),
  rs AS (SELECT symbol, win::INT AS win, count(*) AS n, any_value(cur) AS current, avg((r < cur)::INT) * 100 AS pct, (any_value(cur) - avg(r)) / (stddev_samp(r) + 1e-9) AS z FROM c GROUP BY symbol, win HAVING count(*) >= 60)"""
_STATE = "CASE WHEN pct >= 50 THEN CASE WHEN abs(pct - 50) * 2 >= 90 THEN 'hot' WHEN abs(pct - 50) * 2 >= 60 THEN 'warm' ELSE 'normal' END WHEN abs(pct - 50) * 2 >= 60 THEN 'cooling' ELSE 'normal' END"


@query("e05_w20_relative_strength", f"WITH {RS_SQL} SELECT *, {_STATE} AS state FROM rs", "current pct z")
def strength(spark, d):
    return E.relative_strength(M.daily_bars(spark, d), M.benchmark(spark, d))


@query("t07_most_extreme", f"WITH {RS_SQL} SELECT symbol, win, pct FROM rs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pct DESC, win) = 1 AND pct >= 75", "pct")
def extreme(spark, d):
    return E.most_extreme_hot(E.relative_strength(M.daily_bars(spark, d), M.benchmark(spark, d)))


@query(
    "e05_resolution",
    f"""WITH RECURSIVE {B}, {BE}, j AS (SELECT symbol, date, ln(close) - ln(bench) AS rel FROM bars JOIN bench USING (date)),
      x AS (SELECT symbol, row_number() OVER w - 1 AS pos, rel - lag(rel, 20) OVER w AS r, lead(rel, 40) OVER w - rel AS later, {_TAIL} FROM j {SW}),
      q AS (SELECT symbol, quantile_cont(r, 0.9) AS cut FROM x WHERE back > 1 AND r IS NOT NULL GROUP BY symbol),
      hit AS (SELECT symbol, pos, later FROM x JOIN q USING (symbol) WHERE r >= cut AND later IS NOT NULL AND back > 1), {thin_sql('hit', 40, 'symbol')}
    SELECT symbol, count(*) AS n, count(*) FILTER (later < 0) AS fell FROM hit JOIN kept USING (symbol, pos) GROUP BY symbol""",
)
def resolutions(spark, d):
    return E.resolution(M.daily_bars(spark, d), M.benchmark(spark, d))


@query(
    "e07_find_analogs",
    f"""WITH RECURSIVE {B}, x AS (SELECT symbol, date, row_number() OVER w - 1 AS pos, close, close / ({_ma(252, 'close', 'max', 60)}) - 1 AS dd, {_ma(200)} AS ma, lead(close, 126) OVER w / close - 1 AS fwd, {_TAIL},
        list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 126 FOLLOWING) AS l FROM bars {SW}),
      y AS (SELECT *, close / ma - 1 AS ext, ma >= lag(ma, 20) OVER w AS intact FROM x {SW}), n AS (SELECT symbol, dd AS dd0, ext AS ext0 FROM y WHERE back = 1),
      hit AS (SELECT y.* FROM y JOIN n USING (symbol) WHERE abs(dd - dd0) <= 0.06 AND abs(ext - ext0) <= 0.05 AND intact AND fwd IS NOT NULL), {thin_sql('hit', 126, 'symbol')}
    SELECT symbol, date, list_min(l) / l[1] - 1 AS worst, (list_position(l, list_min(l)) - 1)::INT AS days_to_trough, fwd FROM hit JOIN kept USING (symbol, pos)""",
    "worst fwd",
)
def analogs(spark, d):
    return E.find_analogs(M.daily_bars(spark, d))


@query(
    "e08_handoff_prompt",
    f"WITH {B} SELECT symbol, 'Explain these dates of ' || symbol || ': ' || string_agg(strftime(date, '%Y-%m-%d'), ', ' ORDER BY date) AS prompt FROM bars WHERE day(date) <> 15 GROUP BY symbol",
)
def handoff(spark, d):
    b = M.daily_bars(spark, d).select("symbol", "date")
    lib = b.where(F.dayofmonth("date") == 15).select(F.col("symbol").alias("asset"), F.col("date").alias("event_date"), F.lit("known").alias("cause"))
    return E.handoff_text(E.annotate_episodes(b, lib))


@query(
    "e09_verdict_triggers",
    f"""WITH {B}, {BE}, al AS (SELECT symbol, date, close, volume, low, last_value(bench IGNORE NULLS) OVER w AS bench, row_number() OVER w AS rn, {_TAIL} FROM bars LEFT JOIN bench USING (date) {SW}),
      a AS (SELECT *, close - lag(close) OVER w AS dd, close / lag(close) OVER w - 1 AS r1, coalesce(close >= ({_ma(20)}), false) AS up, {_ma(200)} AS ma200, close / ({_ma(252, 'close', 'max', 60)}) - 1 AS draw, ln(close) - ln(bench) AS rel FROM al {SW}),
      b AS (SELECT *, rn - coalesce(max(CASE WHEN NOT up THEN rn END) OVER w, 0) AS streak, ma200 - lag(ma200, 20) OVER w AS slope, {_ma(20, 'r1', 'stddev_samp')} AS vol, rel - lag(rel, 10) OVER w AS short, rel - lag(rel, 100) OVER w AS long,
        coalesce(sum(volume) FILTER (dd >= 0) OVER q, 0) / sum(volume) FILTER (dd < 0) OVER q AS ratio, close <= min(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AND NOT bench <= min(bench) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS breaks FROM a {SW}, q AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)),
      c AS (SELECT *, lag(vol, 10) OVER w AS vol_b, lag(ratio, 5) OVER w AS ratio_b, CASE WHEN short <= min(short) OVER w THEN rn END AS lowrn, count(long) OVER h >= 126 AND long <= min(long) OVER h AS long_low FROM b {SW}, h AS (PARTITION BY symbol ORDER BY date ROWS 125 PRECEDING)),
      e AS (SELECT *, rn - max(lowrn) OVER w AS quiet FROM c {SW}),
      sx AS (SELECT symbol, date, low, min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m, {_TAIL} FROM bars), sy AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM sx WHERE low = m AND back BETWEEN 6 AND 55),
      sw AS (SELECT symbol, max(low) FILTER (rk = 1) AS latest, max(low) FILTER (rk = 2) AS prior FROM sy GROUP BY symbol), l AS (SELECT e.*, CASE WHEN prior IS NOT NULL THEN latest END AS latest, prior FROM e LEFT JOIN sw USING (symbol) WHERE back = 1)
    SELECT symbol, t.id, t.direction, t.threshold, t.current, coalesce(t.met, false) AS met FROM (SELECT symbol, unnest([
      {{'id': 'above_ma20_3d', 'direction': 'upgrade', 'threshold': 3.0::DOUBLE, 'current': streak::DOUBLE, 'met': streak >= 3}}, {{'id': 'higher_swing_low', 'direction': 'upgrade', 'threshold': prior, 'current': latest, 'met': latest > prior}},
      {{'id': 'rs_short_stops_new_lows', 'direction': 'upgrade', 'threshold': 5.0, 'current': quiet::DOUBLE, 'met': quiet >= 5}}, {{'id': 'updown_vol_ratio_above_1.2', 'direction': 'upgrade', 'threshold': 1.2, 'current': ratio, 'met': ratio >= 1.2}},
      {{'id': 'vol20d_falling_above_low', 'direction': 'upgrade', 'threshold': vol_b, 'current': vol, 'met': vol < vol_b AND close >= latest}}, {{'id': 'new_low_benchmark_holds', 'direction': 'downgrade', 'threshold': 1.0, 'current': breaks::INT::DOUBLE, 'met': breaks}},
      {{'id': 'ma200_slope_negative', 'direction': 'downgrade', 'threshold': 0.0, 'current': slope, 'met': slope < 0}}, {{'id': 'updown_vol_ratio_below_0.6_falling', 'direction': 'downgrade', 'threshold': 0.6, 'current': ratio, 'met': ratio < 0.6 AND ratio < ratio_b}},
      {{'id': 'drawdown_beyond_mc_p25', 'direction': 'downgrade', 'threshold': NULL, 'current': draw, 'met': false}}, {{'id': 'rs_long_new_6mo_low', 'direction': 'downgrade', 'threshold': 1.0, 'current': long_low::INT::DOUBLE, 'met': long_low}}]) AS t FROM l)""",
    "threshold current",
    places=4,
)
def vtriggers(spark, d):
    return E.verdict_triggers(M.daily_bars(spark, d), M.benchmark(spark, d))


@query("e09_simulated_triggers")
def simulated_triggers(spark, d):
    """All ten triggers, the drawdown beyond the simulated 25th-percentile trough too."""
    bars = M.daily_bars(spark, d)
    return E.verdict_triggers(bars, M.benchmark(spark, d), E.trough_summary(E.scenario_paths(E.dip_states(bars))))


@query("e04_a19_w32_bottom_scenarios")
def scenarios(spark, d):
    states = E.dip_states(M.daily_bars(spark, d))
    return E.scenario_report(states, E.scenario_paths(states))


@query("a20_fan_chart")
def fan(spark, d):
    return E.fan_chart(E.scenario_paths(E.dip_states(M.daily_bars(spark, d))))


@query(
    "a21_mixture_quantile",
    """WITH a AS (SELECT o_orderpriority AS k, o_totalprice AS v, 0.3 / count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus = 'O') AS w, o_orderstatus = 'O' AS s FROM orders),
      b AS (SELECT k, v, CASE WHEN s THEN w ELSE w / 0.3 * 0.7 END AS w FROM a), c AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v RANGE UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY k) AS t FROM b)
    SELECT k, min(v) AS value FROM c WHERE c >= 0.25 * t - 1e-12 GROUP BY k""",
    "value",
    places=4,
)
def mixture(spark, d):
    o = M.table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "O").alias("s"))
    n = F.count(F.lit(1)).over(W.partitionBy("k", "s"))
    return E.weighted_quantile(o.withColumn("w", F.when(F.col("s"), 0.3).otherwise(0.7) / n), ["k"], 0.25)


# ---- research claims

_DIMS = ["vix_label", "credit_label", "trend"]
EPISODES_SQL = f"""{REGIMES_SQL}, fx AS (SELECT symbol, date, lead(close, 126) OVER w / close - 1 AS ret, min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 126 FOLLOWING) / close - 1 AS dd FROM bars {SW}),
  ep AS (SELECT symbol, date, ret, dd, vix_label, credit_label, trend FROM rg JOIN fx USING (symbol, date) WHERE ret IS NOT NULL)"""
_ONE = [f"'{d}=' || {d}" for d in _DIMS]
_TWO = [f"{a} || '&' || {b}" for i, a in enumerate(_ONE) for b in _ONE[i + 1 :]]
_TRIED = [f"count(DISTINCT {d})" for d in _DIMS]
_TRIED += [f"{a} * {b}" for i, a in enumerate(_TRIED) for b in _TRIED[i + 1 :]]
CLAIMS_SQL = f"""{EPISODES_SQL}, cj AS (SELECT symbol, date, ret, dd, unnest([{', '.join(_ONE + _TWO)}]) AS c FROM ep),
  sr AS (SELECT symbol, ({' + '.join(_TRIED)})::BIGINT AS searched FROM ep GROUP BY symbol),
  cl2 AS (SELECT symbol, c, count(*) AS n, quantile_cont(ret, 0.5) AS median, min(ret) AS floor, min(dd) AS worst_dd, greatest(avg((ret > 0)::INT), 1 - avg((ret > 0)::INT)) AS consistency, count(DISTINCT floor(year(date) / 10)) AS decades,
    array_to_string((CASE WHEN quantile_cont(ret, 0.5) >= 0 THEN list_sort(list(date) FILTER (ret < 0)) ELSE list_sort(list(date) FILTER (ret >= 0)) END)[1:4], ' ') AS exceptions FROM cj GROUP BY symbol, c HAVING count(*) >= 4)"""


def episodes(spark, d):
    x = regime_bars(spark, d)
    w = series()
    x = x.withColumn("ret", F.lead("close", 126).over(w) / F.col("close") - 1).withColumn("dd", F.min("close").over(w.rowsBetween(0, 126)) / F.col("close") - 1)
    return x.where("ret is not null")


@query("a06_a07_claims", f"WITH {CLAIMS_SQL} SELECT * REPLACE (coalesce(exceptions, '') AS exceptions) FROM cl2 JOIN sr USING (symbol)", "median floor worst_dd consistency")
def claims(spark, d):
    c = R.claims(episodes(spark, d), _DIMS, ["symbol"], 4)
    return c.select("symbol", F.array_join("conditions", "&").alias("c"), "n", "median", "floor", "worst_dd", "consistency", "decades", F.array_join(F.transform("exceptions", lambda x: x.cast("string")), " ").alias("exceptions"), "searched")


@query(
    "t05_f04_top_claims",
    f"""WITH {CLAIMS_SQL}, z AS (SELECT *, (consistency - 0.5) / sqrt(0.25 / n) AS z, sqrt(2 * ln(greatest(searched, 2))) AS zc, len(string_split(c, '&')) AS depth FROM cl2 JOIN sr USING (symbol)),
      y AS (SELECT symbol, c, 100 * least(1.0, n / 12.0) * consistency * pow(0.85, depth) * least(1.0, decades / 4.0) * CASE WHEN z > 0 THEN greatest(z - zc, 0) / (greatest(z - zc, 0) + zc) ELSE 0 END AS raw FROM z)
    SELECT symbol, c, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(raw) DESC, c) AS rk FROM y) WHERE rk <= 15""",
)
def top_claims(spark, d):
    c = R.claims(episodes(spark, d), _DIMS, ["symbol"], 4).withColumn("c", F.array_join("conditions", "&"))
    return c.withColumn("rk", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("confidence"), "c"))).where("rk <= 15").select("symbol", "c", "rk")


@query(
    "a02_a04_e11_study_summary",
    f"""WITH {B}, f AS (SELECT symbol, date, close / ({_ma(200)}) - 1 AS ext, close / lag(close, 126) OVER w - 1 AS t126, close / lag(close, 252) OVER w - 1 AS t252, lead(close, 126) OVER w / close - 1 AS fwd FROM bars {SW}),
      t AS (SELECT symbol, date, fwd, 'ext200' AS trig FROM f WHERE ext >= 0.01 AND t126 >= 0.02 UNION ALL SELECT symbol, date, fwd, 'tsmom_pos' FROM f WHERE t252 > 0 UNION ALL SELECT symbol, date, fwd, 'tsmom_neg' FROM f WHERE t252 <= 0)
    SELECT trig, count(*) AS n, count(fwd) AS n_complete, quantile_cont(fwd, 0.5) AS median, min(fwd) AS worst, count(*) FILTER (fwd > 0)::DOUBLE / nullif(count(fwd), 0) AS pct_positive FROM t GROUP BY trig""",
    "median worst pct_positive",
)
def summary(spark, d):
    x = R.trigger_columns(R.indicators(M.daily_bars(spark, d)), ext=0.01, trail=0.02)
    x = x.withColumn("fwd", F.lead("close", 126).over(series()) / F.col("close") - 1)
    t = x.withColumn("trig", F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("ext200", "tsmom_pos", "tsmom_neg")]))))
    return t.groupBy("trig").agg(
        F.count("*").alias("n"), F.count("fwd").alias("n_complete"), F.percentile("fwd", 0.5).alias("median"), F.min("fwd").alias("worst"),
        F.try_divide(F.count(F.when(F.col("fwd") > 0, 1)).cast("double"), F.count("fwd")).alias("pct_positive"),
    )


@query("e11_research_study")
def research_study(spark, d):
    """Every symbol, trigger and sampling; the thresholds suit the proxies' small moves."""
    return R.study(M.daily_bars(spark, d), ext=0.01, trail=0.02, strength=0.02)


# ---- rotation

@query("w18_rs_table", f"WITH {P}, {BE}, j AS (SELECT symbol, date, close, last_value(bench IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS bench FROM panel LEFT JOIN bench USING (date)), x AS (SELECT symbol, " + ", ".join(f"((close / lag(close, {h}) OVER w - 1) - (bench / lag(bench, {h}) OVER w - 1)) * 100 AS x{h}" for h in (21, 63, 126, 252)) + f", {_TAIL} FROM j {SW}) SELECT symbol, x21, x63, x126, x252, row_number() OVER (ORDER BY coalesce(x63, -999) DESC, symbol)::INT AS rk FROM x WHERE back = 1", "x21 x63 x126 x252", places=4)
def rs_table(spark, d):
    return ST.rs_table(M.panel_bars(spark, d), M.benchmark(spark, d))


@query(
    "w19_rs_curves",
    f"""WITH {P}, {BE}, j AS (SELECT symbol, date, close / last_value(bench IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS ratio, {_TAIL} FROM panel LEFT JOIN bench USING (date)),
      x AS (SELECT symbol, date, ratio / first_value(ratio) OVER w * 100 AS rebased, row_number() OVER w - 1 AS i FROM j WHERE back <= 252 {SW}) SELECT symbol, date, rebased FROM x WHERE i % 3 = 0""",
    "rebased",
    places=4,
)
def rs_curves(spark, d):
    return ST.rs_curves(M.panel_bars(spark, d), M.benchmark(spark, d))




@query("e12_leader_runs", f"WITH {_LRUN} SELECT leader, min(date) AS start, max(date) AS stop, count(*) AS rows FROM lr WHERE leader <> 'unknown' GROUP BY run, leader HAVING count(*) >= 10")
def leader_runs(spark, d):
    return ST.leader_runs(leaders(spark, d))


@query("p16_e22_rotation_context", f"WITH {_LRUN}, {CONTEXT_SQL} SELECT * FROM cx", "spread age_weeks", places=4)
def rotation_context(spark, d):
    return rotation(spark, d)


@query(
    "a08_best_follower",
    f"""WITH {_LRUN}, onset AS (SELECT leader, min(date) AS date FROM lr WHERE leader <> 'unknown' GROUP BY run, leader HAVING count(*) >= 10),
      fp AS (SELECT symbol, date, lead(close, 63) OVER w / close - 1 AS fwd FROM panel {SW}),
      bf AS (SELECT leader, date, symbol FROM onset JOIN fp USING (date) WHERE fwd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY leader, date ORDER BY fwd DESC, symbol) = 1)
    SELECT leader, symbol, times FROM (SELECT leader, symbol, count(*) AS times, min(date) AS seen FROM bf GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY leader ORDER BY times DESC, seen) = 1""",
)
def best_follower(spark, d):
    return ST.best_followers(M.panel_bars(spark, d), ST.leader_runs(leaders(spark, d)))


@query(
    "e13_macro_block",
    f"""WITH {CR}, {BE}, m AS (SELECT 'credit' AS series, date, credit AS value FROM credit UNION ALL SELECT 'bench', date, bench FROM bench), y AS (SELECT *, value / lag(value, 12) OVER (PARTITION BY series ORDER BY date) - 1 AS yoy FROM m),
      l AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) = 1)
    SELECT l.series, l.date, l.value, l.value - (SELECT arg_max(value, date) FROM m WHERE m.series = l.series AND m.date <= l.date - 91) AS change_91d, l.value - (SELECT arg_max(value, date) FROM m WHERE m.series = l.series AND m.date <= l.date - 365) AS change_365d, l.yoy FROM l""",
    "value change_91d change_365d yoy",
    places=4,
)
def macro_block(spark, d):
    c = M.credit(spark, d).select(F.lit("credit").alias("series"), "date", F.col("credit").alias("value"))
    return ST.macro_block(c.unionByName(M.benchmark(spark, d).select(F.lit("bench").alias("series"), "date", F.col("bench").alias("value"))))


# ---- scanner, overlay, ladder

_SCAN = f"""al AS (SELECT symbol, date, close, last_value(bench IGNORE NULLS) OVER w AS bench FROM bars LEFT JOIN bench USING (date) {SW}),
  s1 AS (SELECT symbol, date, close / lag(close) OVER w - 1 AS r1, close - lag(close) OVER w AS dd_, close / ({_ma(252, 'close', 'max')}) - 1 AS dd, (close / lag(close, 63) OVER w - 1) - (bench / lag(bench, 63) OVER w - 1) AS rel63, {_TAIL} FROM al {SW}),
  s2 AS (SELECT symbol, date, greatest(dd_, 0) AS up, greatest(-dd_, 0) AS dn FROM s1 WHERE dd_ IS NOT NULL), u AS {_ewm_sql('up', 1 / 14, 's2', 'symbol, date')}, v AS {_ewm_sql('dn', 1 / 14, 's2', 'symbol, date')},
  sh AS (SELECT symbol, avg((r1 <= cur)::INT) AS share, count(*) AS k FROM (SELECT symbol, r1, arg_max(r1, date) OVER (PARTITION BY symbol) AS cur FROM s1 WHERE r1 IS NOT NULL) GROUP BY symbol),
  mv AS (SELECT symbol, date, vix_label || '/' || credit_label || '/' || trend AS t FROM rg), mw AS (SELECT symbol, date, t <> lag(t, 5) OVER w AS moved FROM mv {SW}),
  sc AS (SELECT s.symbol, s.date, list_filter([CASE WHEN k > 20 AND share <= 0.05 THEN 'return_percentile' END, CASE WHEN rsi <= 30 OR rsi >= 70 THEN 'rsi_extreme' END, CASE WHEN dd <= -0.15 THEN 'drawdown_threshold' END, CASE WHEN rel63 <= -0.05 THEN 'relative_underperformance' END, CASE WHEN moved THEN 'regime_transition' END], lambda x: x IS NOT NULL) AS l
    FROM (SELECT s1.*, 100 - 100 / (1 + u.y / v.y) AS rsi FROM s1 LEFT JOIN u ON u.symbol = s1.symbol AND u.date = s1.date LEFT JOIN v ON v.symbol = s1.symbol AND v.date = s1.date WHERE back = 1) s JOIN sh ON sh.symbol = s.symbol JOIN mw ON mw.symbol = s.symbol AND mw.date = s.date)"""


@query("p21_p22_scanner_triggers", f"WITH {REGIMES_SQL}, {_SCAN} SELECT symbol, date, array_to_string(l, ',') AS triggers, len(list_filter(l, lambda x: x <> 'regime_transition')) > 0 AS qualifies FROM sc")
def scan(spark, d):
    t = ST.scanner_triggers(M.daily_bars(spark, d), M.benchmark(spark, d), regime_bars(spark, d))
    return t.withColumn("triggers", F.array_join("triggers", ","))


@query(
    "e15_f11_t06_scanner_digest",
    f"""WITH st AS ({_replay_sql(_LAST, (5,))}), s AS (SELECT symbol, mean_excess - abs(expected_mae) - 0.5 * (q80 - q20) - 0.0015 + 0.2 * least(1.0, n / 40.0) AS score FROM st)
    SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol)::INT AS rk FROM s""",
    "score",
)
def scanner_digest(spark, d):
    m, rg = inputs(spark, d)
    stats = FC.regime_replay(m.bars, m.bench, rg, FC.last_positions(rg), (5,))
    everyone = m.bars.select("symbol").distinct().withColumn("qualifies", F.lit(True))
    return ST.scanner_digest(everyone, stats)


@query("e15_scanner_digest")
def gated_scanner_digest(spark, d):
    """Setups, gated out and skipped symbols of the last day, from the ensemble's forecasts."""
    m, rg = inputs(spark, d)
    bars, bench = m.bars, m.bench
    last = FC.last_positions(rg)
    f = FC.forecast(bars, bench, rg, last, FC.LIVE_HORIZONS, context=rotation(spark, d)).where("model = 'ensemble'").withColumn("shift", S.ood(F.col("mean_dist"), len(FC.FEATURES))[0])
    triggers = ST.scanner_triggers(bars, bench, rg).join(last, "symbol", "left_semi")
    today = bars.agg(F.max("date")).first()[0]
    return ST.gated_digest(triggers, f, F.lit(today)).withColumn("triggers", F.array_join("triggers", ","))


OVERLAY_SQL = f"""{B}, {_TAGS}, oi AS (SELECT symbol, date, row_number() OVER w - 1 AS pos, close / ({_ma(200)}) - 1 AS ext, close / lag(close, 126) OVER w - 1 AS trail, lead(close, 63) OVER w / close - 1 AS fwd63, lead(close, 126) OVER w / close - 1 AS fwd126,
    min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 126 FOLLOWING) / close - 1 AS max_dd FROM bars {SW}),
  hit AS (SELECT * FROM oi WHERE ext >= 0.01 AND trail >= 0.02), {thin_sql('hit', 21, 'symbol')},
  oe AS (SELECT symbol, date, pos, ext, trail, fwd63, fwd126, max_dd, fwd126 IS NOT NULL AS complete, coalesce((SELECT arg_min(tag, ord) FROM t WHERE date BETWEEN a AND b), 'unknown') AS tag FROM hit JOIN kept USING (symbol, pos))"""


def overlay(spark, d):
    periods = spark.createDataFrame(TAGS, "ord int, a string, b string, tag string").withColumn("a", F.to_date("a")).withColumn("b", F.to_date("b"))
    return ST.overlay_episodes(M.daily_bars(spark, d), periods, ext=0.01, trail=0.02)


@query("e14_overlay_episodes", f"WITH RECURSIVE {OVERLAY_SQL} SELECT * FROM oe", "ext trail fwd63 fwd126 max_dd")
def overlay_episodes(spark, d):
    return overlay(spark, d)


@query(
    "a03_cohorts",
    f"""WITH RECURSIVE {OVERLAY_SQL} SELECT f.tag, count(oe.tag) AS n, count(*) FILTER (complete) AS n_complete, quantile_cont(fwd63, 0.5) FILTER (complete) AS median63, quantile_cont(fwd126, 0.5) FILTER (complete) AS median126, min(max_dd) FILTER (complete) AS worst_dd,
      100.0 * count(*) FILTER (complete AND fwd126 > 0) / nullif(count(*) FILTER (complete), 0) AS pct_positive FROM (VALUES ('boom'), ('late'), ('none')) f(tag) LEFT JOIN oe ON oe.tag = f.tag GROUP BY f.tag""",
    "median63 median126 worst_dd pct_positive",
)
def cohorts(spark, d):
    return ST.cohort_stats(overlay(spark, d), ["boom", "late", "none"])


@query(
    "t03_nearest_overlay",
    f"""WITH RECURSIVE {OVERLAY_SQL}, l AS (SELECT symbol, pos AS p0, ext AS e0, trail AS t0 FROM oe QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1),
      x AS (SELECT symbol, date, sqrt(pow((ext - e0) * 100, 2) + pow((trail - t0) * 100, 2)) AS dist FROM oe JOIN l USING (symbol) WHERE complete AND pos < p0)
    SELECT symbol, date, dist, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dist, date) AS rk FROM x) WHERE rk <= 3""",
    "dist",
)
def nearest_overlay(spark, d):
    return ST.nearest_overlay(overlay(spark, d))


@query("s03_merge_by_month", f"WITH RECURSIVE {OVERLAY_SQL} SELECT symbol, date FROM oe WHERE symbol = 'AF' UNION ALL SELECT symbol, date FROM oe WHERE symbol = 'NO' AND strftime(date, '%Y-%m') NOT IN (SELECT strftime(date, '%Y-%m') FROM oe WHERE symbol = 'AF')")
def months(spark, d):
    e = overlay(spark, d).select("symbol", "date")
    return ST.merge_by_month(e.where("symbol = 'AF'"), e.where("symbol = 'NO'"))


@query(
    "e17_f18_deployment_ladder",
    f"""WITH {REGIMES_SQL}, ev(e, note) AS (VALUES (DATE '1995-06-01', 'SEP'), (DATE '1998-06-01', NULL)), cj AS (SELECT date, credit, credit - lag(credit, 21) OVER (ORDER BY date) AS jump FROM credit),
      x AS (SELECT b.symbol, b.date, b.close, {_ma(20, 'b.close', 'max').replace('symbol', 'b.symbol').replace('ORDER BY date', 'ORDER BY b.date')} AS high20, vix_label = 'stressed' AND trend = 'below' AND credit_label = 'widening' AS brk, c.credit, c.jump
        FROM bars b JOIN rg USING (symbol, date) LEFT JOIN cj c ON c.date = b.date),
      y AS (SELECT *, EXISTS (SELECT 1 FROM ev WHERE e = date OR (note = 'SEP' AND date - e BETWEEN 1 AND 3)) AS blackout, coalesce(credit >= 8 OR jump >= 1.5, false) AS blowout FROM x)
    SELECT symbol, date, blackout, blowout, abs(close / 30000.0 - 1) >= 0.10 OR date - DATE '1996-01-01' >= 63 AS rebaseline, date >= DATE '1995-06-01' AND NOT (blackout OR blowout) AS tranche1,
      (CASE WHEN blackout OR blowout OR high20 IS NULL THEN 0 ELSE (close / high20 - 1 <= -0.03)::INT + (close / high20 - 1 <= -0.06)::INT + (close / high20 - 1 <= -0.1)::INT END)::INT AS rungs, brk AND NOT (blackout OR blowout) AS tranche3, 2.5::DOUBLE AS weekly, 20.0::DOUBLE AS reserve FROM y""",
    "weekly reserve",
)
def ladder(spark, d):
    rg = regime_bars(spark, d).withColumn("high20", rolling(F.max, "close", 20))
    w = W.partitionBy(F.lit(1)).orderBy("date")
    c = M.credit(spark, d).withColumn("credit_jump", F.col("credit") - F.lag("credit", 21).over(w))
    broke = (F.col("vix_label") == "stressed") & (F.col("trend") == "below") & (F.col("credit_label") == "widening")
    last = rg.withColumn("regime_break", broke).join(c, "date", "left").select("symbol", "date", "close", "high20", "regime_break", "credit", "credit_jump")
    events = spark.createDataFrame([("1995-06-01", "SEP"), ("1998-06-01", None)], "date string, note string").withColumn("date", F.to_date("date"))
    return ST.deployment_ladder(last, events, [(-0.03, 10.0), (-0.06, 15.0), (-0.1, 25.0)], 2.5, 20.0, 30000.0, "1996-01-01")


# ---- validation

@query("w31_purged_folds", """WITH f AS (SELECT k AS fold, k * 250 AS test_start, CASE WHEN k = 3 THEN 1003 ELSE (k + 1) * 250 END AS test_end FROM range(1, 4) t(k)),
      g AS (SELECT *, greatest(0, test_start - 5) AS train_end FROM f), h AS (SELECT *, CASE WHEN fold = 1 THEN train_end ELSE least(test_start, train_end) END AS hole_start, CASE WHEN fold = 1 THEN train_end ELSE least(test_start + 21, train_end) END AS hole_end FROM g)
    SELECT * FROM h WHERE train_end - (hole_end - hole_start) >= 100""")
def folds(spark, d):
    return V.purged_folds(spark, 1003, 3, 5, 21, 100)


@query("r09_f23_hmm_states")
def hmm(spark, d):
    return V.hmm_regimes(V.hmm_features(M.benchmark(spark, d), M.credit(spark, d)))


@query("e23_a26_walk_forward")
def walk_forward(spark, d):
    return V.hmm_walk_forward(V.hmm_features(M.benchmark(spark, d), M.credit(spark, d)))


# ---- scalar functions over orders and line items

@query(
    "f01_f02_f03_deflation",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS n, 0.5 + 4 * l_discount AS c, l_linenumber * 6 AS s FROM lineitem), z AS (SELECT *, (c - 0.5) / sqrt(0.25 / n) AS z, sqrt(2 * ln(greatest(s, 2))) AS zc FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, z, zc, CASE WHEN z > 0 THEN greatest(z - zc, 0) / (greatest(z - zc, 0) + zc) ELSE 0 END AS factor FROM z""",
    "l_extendedprice z zc factor",
)
def deflation(spark, d):
    n, c, s = F.col("l_quantity"), 0.5 + 4 * F.col("l_discount"), F.col("l_linenumber") * 6
    return M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", S.z_score(c, n).alias("z"), S.expected_max_z(s).alias("zc"), S.deflation(c, n, s).alias("factor"))


@query(
    "f05_f07_confidence_labels",
    """WITH x AS (SELECT o_orderkey, (o_orderkey % 60)::INT AS n, (o_orderkey % 97) / 96.0 AS p, -((o_orderkey % 13) / 100.0) AS mae, o_orderkey % 5 = 0 AS conc, (o_orderkey % 89) / 88.0 AS a, (o_orderkey % 83) / 82.0 AS r FROM orders),
      y AS (SELECT *, greatest(0, least(100, round_even(100 * least(1.0, n / 40.0) * greatest(p, 1 - p) * (1 - abs(a - r)) * 0.9 - CASE WHEN conc THEN 20 ELSE 0 END, 0))) / 100 AS score FROM x),
      w AS (SELECT *, CASE WHEN score >= 0.7 AND NOT conc THEN 'high' WHEN score >= 0.4 THEN 'moderate' ELSE 'low' END AS lab FROM y)
    SELECT o_orderkey, score, lab, CASE WHEN n < 8 OR lab = 'low' THEN 'no_reliable_signal' WHEN abs(p - 0.5) < 0.05 THEN 'hold_no_change' WHEN p < 0.5 AND (p <= 0.4 OR mae < -0.08) THEN 'reduce_defensive_candidate' WHEN p < 0.5 THEN 'watch_for_confirmation'
      WHEN lab = 'high' AND p >= 0.62 AND mae > -0.08 THEN 'high_conviction_long_candidate' WHEN p >= 0.55 THEN 'moderate_long_candidate' ELSE 'watch_for_confirmation' END AS label FROM w""",
    "score",
)
def confidence(spark, d):
    k = F.col("o_orderkey")
    x = M.table(spark, d, "orders").select("o_orderkey", (k % 60).cast("int").alias("n"), ((k % 97) / 96.0).alias("p"), (-((k % 13) / 100.0)).alias("mae"), (k % 5 == 0).alias("conc"), ((k % 89) / 88.0).alias("a"), ((k % 83) / 82.0).alias("r"))
    no = F.lit(False)
    x = x.withColumn("score", S.compute_confidence(F.col("n"), F.col("p"), F.col("a"), F.col("r"), F.lit(0.9), no, no, no, F.col("conc")))
    x = x.withColumn("lab", S.forecast_confidence_label(F.col("score"), F.col("conc")))
    return x.select("o_orderkey", "score", "lab", S.recommendation(F.col("n"), F.col("p"), F.col("mae"), F.col("lab")).alias("label"))


@query(
    "f08_f13_f14_f16_scalars",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 20 < 8 THEN 'INSUFFICIENT_EVIDENCE' WHEN (o_orderkey % 11) / 20.0 - 0.25 <= -0.08 OR -((o_orderkey % 7) / 40.0) < -0.12 THEN 'AVOID' WHEN (o_orderkey % 11) / 20.0 - 0.25 >= 0.08 THEN 'BUY' ELSE 'WAIT' END AS verdict,
      0.02 / (o_totalprice / 1000000 * sqrt(20 / 252.0)) AS per_vol, (o_orderkey % 9)::DOUBLE > sqrt(15) AS ood, greatest(0, least(1, 1 - (o_orderkey % 9) / (2 * sqrt(15)))) AS density, pow((o_orderkey % 11) / 10.0 - (o_orderkey % 2 = 0)::INT, 2) AS brier,
      -CASE WHEN o_orderkey % 2 = 0 THEN ln(greatest(1e-6, least(1 - 1e-6, (o_orderkey % 11) / 10.0))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, (o_orderkey % 11) / 10.0))) END AS log_loss, o_orderkey % 12 >= 8 AS blowout FROM orders""",
    "per_vol density brier log_loss",
)
def scalars(spark, d):
    k = F.col("o_orderkey")
    far, density = S.ood((k % 9).cast("double"))
    p, hit = (k % 11) / 10.0, k % 2 == 0
    return M.table(spark, d, "orders").select(
        "o_orderkey", S.dip_verdict(k % 20, (k % 11) / 20.0 - 0.25, -((k % 7) / 40.0), F.lit(False)).alias("verdict"), S.return_per_vol(F.lit(0.02), F.col("o_totalprice") / 1000000, F.lit(20)).alias("per_vol"), far.alias("ood"), density.alias("density"),
        S.brier(p, hit).alias("brier"), S.log_loss(p, hit).alias("log_loss"), S.credit_blowout(k % 12, F.lit(None).cast("double")).alias("blowout"),
    )


@query(
    "f20_f21_f22_votes",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'AVOID' ELSE 'WAIT' END AS trend_vote, CASE WHEN o_orderkey % 15 > 10 THEN 'AVOID' WHEN o_orderkey % 15 < 3 THEN 'BUY' ELSE 'WAIT' END AS trough_vote,
      ((o_orderkey % 2 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 13 > 6)::INT)::INT AS gates, least(0.7, 0.7 * (o_orderkey % 14) / 10.0) AS confidence, 100 * least(1.0, (o_orderkey % 14) / 10.0) AS weight FROM orders""",
    "confidence weight",
)
def votes(spark, d):
    k = F.col("o_orderkey")
    trend = F.when(k % 3 == 0, "uptrend").when(k % 3 == 1, "downtrend").otherwise("mixed")
    sign = F.when(k % 2 == 0, "accumulation").otherwise("balanced")
    return M.table(spark, d, "orders").select(
        "o_orderkey", S.trend_vote(trend).alias("trend_vote"), S.trough_vote(-(k % 15).cast("double")).alias("trough_vote"), S.gate_count(sign, k % 5 == 0, (k % 13).cast("double")).alias("gates"), S.scenario_confidence(k % 14).alias("confidence"), S.mix_weight(k % 14).alias("weight"),
    )


@query("f25_required_fields", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'ticker' END, CASE WHEN event_id % 3 = 0 THEN 'horizon' END], lambda x: x IS NOT NULL), ',') AS missing FROM events")
def required(spark, d):
    k = F.col("event_id")
    t, h = F.when(k % 2 != 0, F.lit("x")).otherwise(""), F.when(k % 3 != 0, F.lit(5))
    return M.table(spark, d, "events").select("event_id", F.array_join(S.missing_fields({"ticker": t, "horizon": h}), ",").alias("missing"))


@query("f26_f27_f29_slices", "SELECT c_custkey, array_to_string(string_split(c_name, '#')[1:1], '') AS head, upper(c_mktsegment) AS up, substr(c_name, 1, 3) AS pre, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'XHB' END, 'UNTRACKED') AS proxy FROM customer")
def slices(spark, d):
    proxy = F.coalesce(F.create_map(F.lit("BUILDING"), F.lit("XHB"))[F.col("c_mktsegment")], F.lit("UNTRACKED"))
    return M.table(spark, d, "customer").select("c_custkey", F.array_join(F.slice(F.split("c_name", "#"), 1, 1), "").alias("head"), F.upper("c_mktsegment").alias("up"), F.substring("c_name", 1, 3).alias("pre"), proxy.alias("proxy"))


@query("f28_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round_even(l_quantity / 8, 1) AS r FROM lineitem", "l_quantity r")
def half_even(spark, d):
    return M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.bround(F.col("l_quantity") / 8, 1).alias("r"))


@query("a24_a25_counters", f"WITH {B} SELECT symbol, count(DISTINCT floor(year(date) / 10)) AS decades, count(*) FILTER (lead20 IS NOT NULL) AS matured, count(*) FILTER (lead20 IS NULL) AS not_yet FROM (SELECT *, lead(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS lead20 FROM bars) GROUP BY symbol")
def counters(spark, d):
    x = M.daily_bars(spark, d).withColumn("l", F.lead("close", 20).over(series()))
    return x.groupBy("symbol").agg(F.count_distinct(F.floor(F.year("date") / 10)).alias("decades"), F.count("l").alias("matured"), F.count(F.when(F.col("l").isNull(), 1)).alias("not_yet"))


@query("t01_t08_last_rows", f"WITH {B} SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60", "close", places=4)
def last_rows(spark, d):
    return M.daily_bars(spark, d).withColumn("back", T.tail_rank()).where("back <= 60").select("symbol", "date", "close")


@query("s01_s06_set_operations", f"WITH {B} SELECT DISTINCT year(date) AS y, 'bars' AS src FROM bars UNION ALL (SELECT DISTINCT year(o_orderdate), 'orders' FROM orders EXCEPT SELECT 1996, 'orders')")
def set_operations(spark, d):
    a = M.daily_bars(spark, d).select(F.year("date").cast("long").alias("y"), F.lit("bars").alias("src")).distinct()
    o = M.table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.lit("orders").alias("src")).distinct()
    return a.unionByName(o.subtract(o.where("y = 1996")))


@query("io17_json_digest", f"WITH {B} SELECT '[' || string_agg('{{\"symbol\":\"' || symbol || '\",\"n\":' || n || '}}', ',' ORDER BY symbol) || ']' AS json FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)")
def digest(spark, d):
    return ST.digest_json(M.daily_bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n")), "symbol")


@query("e19_single_replay", f"{_forecast_sql(_LAST, FC.HORIZONS)} SELECT * FROM fcast WHERE model = 'ensemble' AND symbol = 'NO'", _FORECAST_D, places=4)
def single(spark, d):
    m, rg = inputs(spark, d)
    q = FC.last_positions(rg).where("symbol = 'NO'")
    return FC.forecast(m.bars, m.bench, rg, q, context=rotation(spark, d)).where("model = 'ensemble'")


_ROWS = "p_positive, label, n::BIGINT AS n, q50"


@query(
    "e21_forecast_rows",
    f"""SELECT 'create_forecast:' || substr(sha256(ticker || '|' || strftime(trading_date, '%Y-%m-%d') || '|' || horizon || '|tidemark-1|' || voter), 1, 16) AS forecast_id, * FROM (
      SELECT symbol AS ticker, as_of AS trading_date, h AS horizon, 'ensemble' AS voter, {_ROWS} FROM ({_forecast_sql(_LAST, FC.LIVE_HORIZONS)} SELECT * FROM fcast) WHERE model = 'ensemble'
      UNION ALL SELECT symbol, date, h, 'dip_context', p_positive, verdict, n, q50 FROM ({_dip_sql(_LAST)})
        JOIN (WITH {B} SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS query_pos FROM bars) USING (symbol, query_pos))""",
    "p_positive q50",
    places=4,
)
def forecast_rows(spark, d):
    """Both voters' rows of each symbol's last date, with two fields read back from their evidence."""
    m, rg = inputs(spark, d)
    last = FC.last_positions(rg)
    stats = FC.forecast(m.bars, m.bench, rg, last, FC.LIVE_HORIZONS, context=rotation(spark, d)).where("model = 'ensemble'")
    rows = FC.ledger_rows(stats, FC.dip_context(m.bars, m.bench, rg, last), rg, "tidemark-1")
    field = lambda name, kind: F.get_json_object("evidence", f"$.{name}").cast(kind).alias(name)
    return rows.select(*rows.columns[:-1], field("n", "long"), field("q50", "double"))
