"""Queries do the whole job of their inventory line."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans import engines, research, studies

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def test_replay_has_every_date_and_both_voters(spark):
    whole, regimes, months = (run(spark, n) for n in ("e20_replay_forecasts", "e20_replay_regimes", "e20_forecast_month_ends"))
    at = lambda x: set(zip(x.symbol, x.query_pos))
    assert at(whole) >= at(regimes) and len(at(whole)) > 5 * len(at(months))
    assert set(whole.h) == {1, 5, 20, 60} and set(whole.model) == {"analog", "regime", "ensemble"}
    keys = ["symbol", "query_pos", "model", "h"]
    both = months.merge(whole, on=keys)
    assert len(both) == len(months) and (both.n_x == both.n_y).all() and (both.p_positive_x - both.p_positive_y).abs().max() < 1e-9
    dips = run(spark, "e20_replay_dips")
    assert set(dips.h) == {21, 63} and len(at(dips)) > 5 * len(at(run(spark, "e02_dip_context")))


def dipping(spark):
    """D falls by 15 % every 100 days and is in a fall now; U rises."""
    rng = np.random.default_rng(3)
    step = np.where(np.arange(560) % 100 < 80, 0.004, -0.012) + rng.normal(0, 0.002, 560)
    closes = {"D": 100 * np.exp(np.cumsum(step[:495])), "U": 100 * np.exp(np.arange(495) * 0.001)}
    rows = [(s, dt.date(2000, 1, 3) + dt.timedelta(i), float(c)) for s, x in closes.items() for i, c in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, date date, close double"), closes["D"]


def test_scenarios_mix_episodes_and_blocks(spark):
    bars, c = dipping(spark)
    high = np.array([c[max(0, i - 251) : i + 1].max() if i >= 59 else np.nan for i in range(len(c))])
    dd = c / high - 1
    kept, last = [], -(10**9)
    for i in np.flatnonzero(np.abs(dd - dd[-1]) <= 0.06):
        if i - last >= 21 and i + 63 < len(c):
            kept.append(i)
            last = i
    want = {tuple(np.round(c[i + 1 : i + 64] / c[i] - 1, 9)) for i in kept}
    assert dd[-1] <= -0.1 and kept
    states = engines.dip_states(bars)
    paths = engines.scenario_paths(states).toPandas()
    assert set(paths.symbol) == {"D"} and len(paths) == 2000 and (paths.path.map(len) == 63).all()
    past = paths[paths.branch == "history"]
    assert len(past) == round(2000 * min(0.7, 0.07 * len(kept))) and {tuple(np.round(p, 9)) for p in past.path} == want
    daily = np.sort(c[1:] / c[:-1] - 1)
    drawn = np.diff(np.log1p(np.stack(paths[paths.branch == "break"].path)), axis=1, prepend=0).ravel()
    at = np.clip(np.searchsorted(daily, np.expm1(drawn)), 1, len(daily) - 1)
    assert np.minimum(abs(daily[at] - np.expm1(drawn)), abs(daily[at - 1] - np.expm1(drawn))).max() < 1e-9
    rows = {r.symbol: r for r in engines.scenario_report(states, engines.scenario_paths(states)).collect()}
    d = rows["D"]
    troughs = np.stack(paths.path).min(axis=1)
    assert not rows["U"].available and rows["U"].q25 is None and d.n_episodes == len(kept) and d.n_sims == 2000
    assert [round(x, 9) for x in (d.median, d.q25, d.q10)] == [round(float(np.quantile(troughs, q)), 9) for q in (0.5, 0.25, 0.1)]
    assert [(r.tranche, r.pctile, round(r.price, 6)) for r in d.ladder] == [(1, None, round(c[-1], 6)), (2, 25, round(c[-1] * (1 + d.q25), 6)), (3, 10, round(c[-1] * (1 + d.q10), 6))]
    assert len(d.history_pool) == len(d.break_pool) == 600 and {round(x, 9) for x in d.history_pool} == {min(p) for p in want}
    fan = engines.fan_chart(engines.scenario_paths(states)).toPandas().sort_values("day")
    assert fan.day.tolist() == list(range(1, 64)) and abs(fan.p10.iloc[9] - np.quantile(np.stack(paths.path)[:, 9], 0.1)) < 1e-9


def test_scenario_queries_have_2000_simulations_and_every_day(spark):
    rows, fan = run(spark, "e04_a19_w32_bottom_scenarios"), run(spark, "a20_fan_chart")
    assert set(rows[rows.available].n_sims) <= {2000} and {"ladder", "history_pool", "break_pool"} <= set(rows.columns)
    assert len(fan) == 63 * rows.available.sum()


def test_live_forecast_has_six_horizons(spark):
    assert set(run(spark, "e01_forecast").h) == {1, 5, 20, 60, 126, 252}
    assert set(run(spark, "e21_forecast_rows").horizon) == {1, 5, 20, 60, 126, 252, 21, 63}


def test_study_samples_every_trigger_of_every_symbol(spark):
    bars, _ = dipping(spark)
    got = {(r.symbol, r.trig, r.sampling): r for r in research.study(bars, ext=0.01, trail=0.02, strength=0.02).collect()}
    assert len(got) == 2 * 4 * 3
    for symbol in "DU":
        x = bars.where(f"symbol = '{symbol}'").toPandas().sort_values("date").close.reset_index(drop=True)
        ma, t126, t252 = x.rolling(200).mean(), x / x.shift(126) - 1, x / x.shift(252) - 1
        masks = {"ext200": (x / ma - 1 >= 0.01) & (t126 >= 0.02), "strength": (x / x.rolling(20).max() - 1 >= -0.02) & (t126 >= 0.02), "tsmom_pos": t252 > 0, "tsmom_neg": t252 <= 0}
        for trig, mask in masks.items():
            every, ups, last, seen = [], [], -(10**9), False
            for i, h in enumerate(mask):
                if h and i - last >= 63:
                    every.append(i)
                    last = i
                seen = seen and x[i] >= ma[i]
                if h and x[i] >= ma[i] and not seen:
                    ups.append(i)
                    seen = True
            for name, at in (("all", every), ("uptrend", ups), ("cross", [i for i in range(1, len(x)) if mask[i] and not mask[i - 1]])):
                r, done = got[symbol, trig, name], [i for i in at if i + 126 < len(x)]
                assert (r.n, r.n_complete) == (len(at), len(done)), (symbol, trig, name)
                if done:
                    assert abs(r.median - np.median([x[i + 126] / x[i] - 1 for i in done])) < 1e-9
                    assert abs(r.worst_dd - min(x[i : i + 127].min() / x[i] - 1 for i in done)) < 1e-9


def test_digest_gates_and_skips(spark):
    day, old = dt.date(2020, 1, 10), dt.date(2020, 1, 9)
    t = spark.createDataFrame([(s, ["rsi_extreme"], s != "Q") for s in "ABGNOQ"], "symbol string, triggers array<string>, qualifies boolean")
    rows = [(s, h, d, label, s == "B", 0.5, 0.02 * h, -0.01, -0.02, 0.03) for s, d, label in (("A", day, "hold_no_change"), ("B", day, "hold_no_change"), ("G", day, "no_reliable_signal"), ("O", old, "hold_no_change"), ("Q", day, "hold_no_change")) for h in (1, 5)]
    f = spark.createDataFrame(rows, "symbol string, h int, as_of date, label string, shift boolean, confidence double, mean_excess double, expected_mae double, q20 double, q80 double")
    got = {r.symbol: r for r in studies.gated_digest(t, f, F.lit(day)).collect()}
    assert {s: (r.kind, r.reason, r.rk) for s, r in got.items()} == {"A": ("setup", None, 1), "B": ("setup", None, 2), "G": ("gated_out", None, None), "N": ("skipped", "no_forecast_available", None), "O": ("skipped", "stale_forecast", None)}
    assert abs(got["A"].score - (0.1 - 0.01 - 0.025 - 0.0015 + 0.1)) < 1e-9 and abs(got["A"].score - got["B"].score - 0.15) < 1e-9


def test_digest_query_has_only_triggered_symbols(spark):
    scan, got = run(spark, "p21_p22_scanner_triggers"), run(spark, "e15_scanner_digest")
    assert set(got.symbol) <= set(scan[scan.qualifies].symbol) and set(got.kind) <= {"setup", "gated_out", "skipped"}
    assert got[got.kind != "setup"].score.isna().all()


def test_drawdown_trigger_has_its_simulated_threshold(spark):
    x, troughs = run(spark, "e09_simulated_triggers"), run(spark, "e04_a19_w32_bottom_scenarios").set_index("symbol")
    x = x[x.id == "drawdown_beyond_mc_p25"].set_index("symbol")
    dips = troughs[troughs.available].index
    assert len(dips) and len(x) == len(troughs)
    assert (abs(x.threshold[dips] - troughs.q25[dips]) < 1e-9).all() and x.threshold.drop(dips).isna().all()
    assert (x.met == (x.current < x.threshold)).all() and x.met.any()
