"""Hand-sized and metamorphic tests of the point-in-time plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alignment, thinning
from tidemark.operators.regimes import with_regimes
from tidemark.operators.windows import ewm, position, with_runs, with_streak
from tidemark.plans import engines, forecast, ledger, validation
from tidemark.plans.technicals import macd, rsi, swing_lows
from tidemark.sources import files, pit

DAY = dt.date(2000, 1, 3)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def make_bars(spark, n, symbols=("A", "B"), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.02, n)))
        rows += [(s, d, float(c), float(c * 1.01), float(c * 0.99), round(float(c), 4), float(rng.integers(50, 150))) for d, c in zip(days(n), close)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def make_macro(spark, n, name, scale, seed):
    rng = np.random.default_rng(seed)
    v = scale * (1 + 0.3 * np.sin(np.arange(n) / 17) + rng.normal(0, 0.1, n))
    return spark.createDataFrame([(d, float(x)) for d, x in zip(days(n), v)], f"date date, {name} double")


# ---- store and as-of reads

def test_as_of_boundary_and_publication_lag(spark):
    rows = [(DAY + dt.timedelta(i), DAY + dt.timedelta(i + lag), float(i)) for i, lag in ((0, 0), (1, 2), (2, 2))]
    t = spark.createDataFrame(rows, "effective_date date, processed_date date, value double")
    assert [r.value for r in pit.as_of(t, str(DAY + dt.timedelta(1))).collect()] == [0.0]
    assert sorted(r.value for r in pit.as_of(t, str(DAY + dt.timedelta(3))).collect()) == [0.0, 1.0]


def test_store_round_trip_and_errors(spark, tmp_path):
    root = str(tmp_path / "pit")
    with pytest.raises(pit.PITStoreError, match="never ingested"):
        pit.PointInTimeContext(spark, root, "2001-01-01").close("A").count()
    b = make_bars(spark, 400)
    pit.write_prices(b, root)
    ctx = pit.PointInTimeContext(spark, root, "2000-06-30")
    got = ctx.close("A")
    assert got.agg(F.max("date")).first()[0] <= dt.date(2000, 6, 30) and got.count() == 180
    with pytest.raises(pit.PITStoreError, match="as of"):
        pit.PointInTimeContext(spark, root, "1999-01-01").close("A")
    with pytest.raises(pit.PITStoreError, match="never"):
        ctx.close("Z")
    with pytest.raises(ValueError):
        pit.write_prices(b.limit(0), root)
    # a year that is written again is replaced, the others stay
    pit.write_prices(b.where("date >= '2001-01-01'").withColumn("close", F.lit(1.0)), root)
    again = pit.PointInTimeContext(spark, root, "2002-01-01").close("A")
    assert again.count() == 400 and again.where("close = 1").count() == b.where("symbol = 'A' and date >= '2001-01-01'").count()
    with pytest.raises(Exception, match="lookahead"):
        pit.assert_no_lookahead(again, "2000-02-01").collect()


# ---- operators

def test_ewm_against_pandas_over_blocks(spark):
    n = 3700
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, n)
    x[:3] = np.nan
    rows = [("A", d, None if np.isnan(v) else float(v)) for d, v in zip(days(n), x)]
    out = ewm(spark.createDataFrame(rows, "symbol string, date date, v double"), "v", 2 / 13, "y").orderBy("date").toPandas()
    want = pd.Series(x).ewm(alpha=2 / 13, adjust=False).mean()
    assert np.allclose(out.y[3:].astype(float), want[3:], atol=1e-9) and out.y[:3].isna().all()


def test_rsi_variants_and_macd(spark):
    flat = [("A", d, 5.0) for d in days(5)] + [("B", d, 5.0 + i) for i, d in enumerate(days(5))]
    out = rsi(spark.createDataFrame(flat, "symbol string, date date, close double")).orderBy("symbol", "date").toPandas()
    assert out.rsi_a[:5].isna().all() and (out.rsi_b[:5] == 50).all() and out.rsi_a[9] == 100 and out.rsi_b[9] == 50
    m = macd(make_bars(spark, 60)).where("symbol = 'A'").orderBy("date").toPandas()
    e = lambda s, n: s.ewm(span=n, adjust=False).mean()
    assert np.allclose(m.macd, e(m.close, 12) - e(m.close, 26), atol=1e-9) and np.allclose(m.signal, e(m.macd, 9), atol=1e-9)


def test_reindex_is_not_asof(spark):
    left = spark.createDataFrame([("A", d) for d in (days(10)[0], days(10)[4], days(10)[5])], "symbol string, date date")
    right = spark.createDataFrame([(days(10)[0], 1.0), (days(10)[3], 2.0), (days(10)[5], 3.0)], "date date, v double")
    exact = [r.v for r in alignment.reindex_ffill(left, right, "v").orderBy("date").collect()]
    asof = [r.v for r in alignment.asof_backward(left, right, "v").orderBy("date").collect()]
    after = [r.v for r in alignment.first_on_or_after(left, right, "v").orderBy("date").collect()]
    assert exact == [1.0, 1.0, 3.0] and asof == [1.0, 2.0, 3.0] and after == [1.0, 3.0, 3.0]


def test_thinning_folds(spark):
    c = spark.createDataFrame([("A", p) for p in (9, 0, 5, 20, 24, 3)], "symbol string, pos long")
    assert sorted(r.pos for r in thinning.greedy_thin(c, 5, ["symbol"]).collect()) == [0, 5, 20]
    one = spark.range(1).select(
        thinning.thin_by_distance(F.array(*[F.lit(x).cast("bigint") for x in (50, 45, 10, 70, 31)]), 20, 3).alias("a"),
        thinning.thin_by_distance(F.array(*[F.lit(x).cast("bigint") for x in (1, 60, 99)]), 20, 9, F.array(F.lit(50).cast("bigint"))).alias("b"),
    ).first()
    assert one.a == [50, 10, 70] and one.b == [50, 1, 99]


def test_runs_and_streaks(spark):
    x = spark.createDataFrame([("A", d, v) for d, v in zip(days(7), ["a", "a", None, None, "b", "a", "a"])], "symbol string, date date, v string")
    assert [r.run for r in with_runs(x, "v").orderBy("date").collect()] == [1, 1, 2, 2, 3, 4, 4]
    assert [r.k for r in with_streak(x, F.col("v") == "a", "k").orderBy("date").collect()] == [1, 2, 0, 0, 0, 1, 2]


def test_swing_lows_ignore_the_edges(spark):
    low = [10.0 + i / 100 for i in range(70)]
    low[30], low[50], low[68], low[2] = 1.0, 2.0, 0.5, 0.1
    rows = [("A", d, v) for d, v in zip(days(70), low)]
    got = swing_lows(spark.createDataFrame(rows, "symbol string, date date, low double")).orderBy("rk").collect()
    assert [r.low for r in got] == [2.0, 1.0]


def test_unknown_regimes_never_match(spark):
    rows = [("A", i, d, "stressed", "unknown", "below") for i, d in enumerate(days(30))] + [("A", 30 + i, d, "calm", "flat", "above") for i, d in enumerate(days(5))]
    rg = spark.createDataFrame(rows + [("A", 35, days(1)[0], "stressed", "unknown", "below")], "symbol string, pos long, date date, vix_label string, credit_label string, trend string")
    q = spark.createDataFrame([("A", 35)], "symbol string, pos long")
    assert {r.depth for r in forecast.regime_matches(rg, q, gap=1).collect()} == {1}
    known = rg.withColumn("credit_label", F.when(F.col("pos") % 2 == 0, "unknown").otherwise("flat"))
    q2 = spark.createDataFrame([("A", 29)], "symbol string, pos long")
    got = forecast.regime_matches(known, q2, gap=1).collect()
    assert {r.depth for r in got} == {3} and sorted(r.pos for r in got) == list(range(1, 29, 2))


# ---- the metamorphic trio

@pytest.fixture(scope="module")
def market(spark):
    n = 420
    return make_bars(spark, n).cache(), make_macro(spark, n, "vix", 20, 1).cache(), make_macro(spark, n, "credit", 3, 2).cache(), make_bars(spark, n, ("*",), 3).select("date", F.col("close").alias("bench")).cache()


def run_forecast(bars, vix, credit, bench, at):
    rg = with_regimes(bars, vix, credit, bench, lookback=60).withColumn("pos", position())
    q = rg.where(F.col("date") == F.lit(at)).select("symbol", "pos")
    out = forecast.forecast(bars, bench, rg, q, (5, 20)).drop("as_of").toPandas()
    return out.sort_values(["symbol", "model", "h"]).reset_index(drop=True).round(9)


def test_truncated_mutated_and_repartitioned_stores_agree(market):
    bars, vix, credit, bench = market
    at = days(420)[380]
    full = run_forecast(bars, vix, credit, bench, at)
    assert len(full) == 12 and full.n.min() > 0
    cut = [x.where(F.col("date") <= F.lit(at)) for x in market]
    pd.testing.assert_frame_equal(full, run_forecast(*cut, at))
    late = F.col("date") > F.lit(at)
    mutated = [x.withColumn(c, F.when(late, F.lit(v)).otherwise(F.col(c))) for x, c, v in zip(market, ("close", "vix", "credit", "bench"), (1.0, 999.0, 99.0, 1.0))]
    pd.testing.assert_frame_equal(full, run_forecast(*mutated, at))
    pd.testing.assert_frame_equal(full, run_forecast(*[x.repartition(5) for x in market], at))


def test_analogs_never_come_from_the_future(spark, market):
    bars, _, _, bench = market
    f = forecast.feature_frame(bars, bench).cache()
    q = spark.createDataFrame([("A", 300)], "symbol string, pos long")
    planted = f.join(f.where("symbol = 'A' and pos = 300").select(*[F.col(c).alias(f"__{c}") for c in forecast.FEATURES]))
    planted = planted.select("symbol", "date", "pos", *[F.when((F.col("symbol") == "A") & (F.col("pos") == 350), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in forecast.FEATURES])
    kept = forecast.analog_matches(planted, q).first().kept
    assert kept and max(kept) < 300 and all(abs(a - b) >= 20 for i, a in enumerate(kept) for b in kept[:i])


def test_scenarios_do_not_depend_on_partitioning(spark, market):
    bars = market[0]
    a = engines.bottom_scenarios(bars, sims=50).orderBy("symbol", "sim").collect()
    b = engines.bottom_scenarios(bars.repartition(9), sims=50).orderBy("symbol", "sim").collect()
    assert a == b and all(r.trough <= 0 for r in a)


# ---- ledger

def test_dead_letter_on_the_fifth_failure(spark):
    rows = spark.createDataFrame([("w1", 0), ("w2", 0)], "write_id string, attempts int")
    bad = spark.createDataFrame([("w1", False), ("w2", True)], "write_id string, ok boolean")
    first = {r.write_id: r.state for r in ledger.advance_staged(rows, bad).collect()}
    assert first == {"w1": "staged", "w2": "persisted"}
    for k in range(1, 6):
        moved = ledger.advance_staged(spark.createDataFrame([("w1", k - 1)], "write_id string, attempts int"), bad).first()
        assert (moved.attempts, moved.state) == (k, "dead_letter" if k == 5 else "staged")


def test_ledger_appends_once_and_validates(spark, tmp_path):
    led = ledger.Ledger(spark, str(tmp_path))
    f = spark.createDataFrame([("f1", "A", DAY, 5, "v"), ("f2", "A", DAY, 20, "v")], "forecast_id string, ticker string, trading_date date, horizon int, voter string")
    led.append_new("forecasts", f, "forecast_id")
    led.append_new("forecasts", f, "forecast_id")
    assert led.table("forecasts").count() == 2
    with pytest.raises(ValueError):
        led.append("forecasts", f.withColumn("ticker", F.lit("")))
    ep = spark.createDataFrame([("A", DAY, "old", 1), ("A", DAY, "new", 2)], "asset string, event_date date, cause string, written_at int")
    led.append("episodes", ep)
    assert [r.cause for r in led.episodes().collect()] == ["new"]
    assert ledger.block_count_map(f).first().counts == {"v_20": 1, "v_5": 1}


def test_committee_states(spark):
    rows = [(1, v, vote, 0.5, n, c) for v, vote, n, c in (("a", "BUY", 9, True), ("b", "BUY", 9, True), ("c", "BUY", 9, True), ("d", "BUY", 9, True), ("e", "AVOID", 9, False))]
    rows += [(2, "a", "INSUFFICIENT_EVIDENCE", 0.9, 9, True)]
    b = spark.createDataFrame(rows, "k int, voter string, vote string, confidence double, independent_n int, calibrated boolean")
    got = {r.k: r for r in forecast.committee(b, ["k"]).collect()}
    assert got[1].state == "agreement" and got[1].mean == 1.0 and got[2].state == "insufficient" and got[2].mean is None


# ---- parsing, scalars, folds

def test_parsers(spark):
    pc = spark.createDataFrame(list(enumerate(["junk", "DATE,CALLS,PUTS,TOTAL,P/C Ratio", "d1,1,2,3,0.5", "d2,1,2,3,1.2", "tail"])), "n int, value string")
    assert tuple(files.parse_put_call(pc).first()) == (1.2, "fear")
    line = ",".join(["S&P CONTRACT"] + ["0"] * 6 + ["1000"] + ["0"] * 6 + ["600", "300"])
    assert tuple(files.parse_positioning(spark.createDataFrame([(line,)], "value string"), "CONTRACT").first()) == (0.3, "crowded_long")
    panel = "<b>January</b><i>28-29</i><b>March</b><i>18-19*</i><b>April</b><i>30-1</i>"
    got = files.parse_event_calendar(spark.createDataFrame([(2025, panel)], "year int, panel string")).collect()
    assert [tuple(r) for r in got] == [(2025, 1, 29, False), (2025, 3, 19, True), (2025, 5, 1, False)]
    with pytest.raises(Exception, match="differ"):
        files.parse_event_calendar(spark.createDataFrame([(2025, "<b>January</b>")], "year int, panel string")).collect()


def test_scalars(spark):
    one = spark.range(1).select(
        S.deflated_confidence(F.lit(12), F.lit(1.0), F.lit(1), F.lit(4), F.lit(2)).alias("d"), S.z_score(F.lit(0.9), F.lit(0)).alias("z"),
        S.ordinal(F.lit(112)).alias("o"), S.percentile_state(F.lit(96.0)).alias("p"), S.recommendation(F.lit(5), F.lit(0.9), F.lit(0.0), F.lit("high")).alias("r"),
        S.write_id("op", F.lit(None), F.lit("a")).alias("w"), S.strength_vote(F.lit(True), F.lit(3), F.lit(60.0), F.lit(-1.0)).alias("v"),
    ).first()
    z, zc = 12**0.5, (2 * np.log(2)) ** 0.5
    assert one.d == round(85 * (z - zc) / z) and one.z == 0 and one.o == "112th" and one.p == "hot" and one.r == "no_reliable_signal" and one.w.startswith("op:") and one.v == "AVOID"


def test_purged_folds(spark):
    f = [tuple(r) for r in validation.purged_folds(spark, 103, 3, 2, 5).orderBy("fold").collect()]
    assert f == [(1, 25, 50, 23, 23, 23), (2, 50, 75, 48, 48, 48), (3, 75, 103, 73, 73, 73)]
    rows = validation.fold_rows(spark.range(103).withColumnRenamed("id", "pos"), validation.purged_folds(spark, 103, 3, 2, 5))
    assert rows.where("role = 'test'").count() == 78 and rows.where("role = 'train' and fold = 2").count() == 48


def test_hmm_finds_two_volatilities():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.3, (150, 2)) for m in (-2, 2, -2, 2)])
    start, move, mean, var = validation.fit_hmm(x, 2)
    gamma, _, ll = validation._posterior(x, start, move, mean, var)
    label = gamma.argmax(1)
    truth = np.repeat([0, 1, 0, 1], 150)
    assert max((label == truth).mean(), (label != truth).mean()) > 0.98 and np.isfinite(ll)
