"""Intraday bars: closed bars, VWAP and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.windows import series
from tidemark.plans.technicals import macd, tail_rank


def closed_bars(bars: DataFrame, now: str, minutes: int = 15) -> DataFrame:
    """Bars that have ended by now; bar_ts is a bar's start."""
    return bars.where(F.col("bar_ts") + F.expr(f"interval {minutes} minutes") <= F.lit(now).cast("timestamp"))


def vwap_by_session(bars: DataFrame) -> DataFrame:
    w = W.partitionBy("symbol", "session").orderBy("bar_ts").rowsBetween(W.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("vwap", F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def vwap_running(bars: DataFrame) -> DataFrame:
    w = series(order="bar_ts").rowsBetween(W.unboundedPreceding, 0)
    return bars.withColumn("vwap", F.try_divide(F.sum(F.col("close") * F.col("volume")).over(w), F.sum("volume").over(w)))


def reclaim_gate(bars: DataFrame, now: str) -> DataFrame:
    """symbol -> open: the last closed bar above VWAP, volume not falling, MACD histogram positive; at least two bars."""
    x = vwap_by_session(closed_bars(bars, now))
    x = macd(x.withColumn("date", F.col("bar_ts")))
    x = x.withColumn("before", F.lag("volume").over(series())).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("symbol"))).withColumn("back", tail_rank())
    ok = (F.col("close") > F.col("vwap")) & (F.col("volume") >= F.col("before")) & (F.col("histogram") > 0) & (F.col("n") >= 2)
    return x.where("back = 1").select("symbol", "bar_ts", F.coalesce(ok, F.lit(False)).alias("open"))


def gate_batch(setups: DataFrame, bars: DataFrame, now: str, top: int = 5) -> DataFrame:
    """setups (symbol, score) -> symbol, rk, verdict, warning of the `top` highest scores (ties: by symbol): GO where the reclaim gate is
    open; a setup without closed bars gets NO-GO and a warning, and doesn't stop the others."""
    ranked = setups.orderBy(F.desc("score"), "symbol").limit(top)  # a top-k report
    ranked = ranked.withColumn("rk", F.row_number().over(W.orderBy(F.desc("score"), "symbol")))
    gate = reclaim_gate(bars.join(ranked.select("symbol"), "symbol", "left_semi"), now)
    warning = F.when(F.col("open").isNull(), "no_closed_bars")
    return ranked.join(gate, "symbol", "left").select("symbol", "rk", F.when(F.col("open"), "GO").otherwise("NO-GO").alias("verdict"), warning.alias("warning"))


def flush_reclaim(bars: DataFrame, daily_range: DataFrame, stall_bars: int = 4) -> DataFrame:
    """symbol, session -> flush, stall, reclaimed, strong, stage: the session's first bar wider than twice the daily range measure
    (symbol, atr) on twice the mean volume; its low holding for the next bars; the last close above the running VWAP, on rising
    volume and price. Sessions with fewer than stall_bars + 2 bars are left out."""
    day = W.partitionBy("symbol", "session").orderBy("bar_ts")
    whole = W.partitionBy("symbol", "session")
    run = day.rowsBetween(W.unboundedPreceding, 0)
    vwap = F.try_divide(F.sum(F.col("close") * F.col("volume")).over(run), F.sum("volume").over(run))
    x = bars.join(daily_range.select("symbol", "atr"), "symbol").withColumn("vwap", vwap).withColumn("i", F.row_number().over(day)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("mean", F.avg("volume").over(whole))
    x = x.where(F.col("n") >= stall_bars + 2)
    x = x.withColumn("f", F.min(F.when((F.col("high") - F.col("low") > 2 * F.col("atr")) & (F.col("volume") > 2 * F.col("mean")), F.col("i"))).over(whole))
    after = F.col("i") > F.col("f")
    g = x.groupBy("symbol", "session").agg(
        F.max("f").alias("f"), F.max("n").alias("n"), F.min(F.when(F.col("i") == F.col("f"), F.col("low"))).alias("flush_low"), F.min(F.when(after & (F.col("i") <= F.col("f") + stall_bars), F.col("low"))).alias("after_low"),
        *[F.max_by(c, "i").alias(c) for c in ("close", "vwap", "volume")], F.max(F.when(F.col("i") == F.col("n") - 1, F.col("close"))).alias("close_b"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("volume"))).alias("volume_b"),
    )
    no, left = F.lit(False), F.col("n") - F.col("f")
    flush = F.col("f").isNotNull()
    stall = F.coalesce((left >= stall_bars) & (F.col("after_low") >= F.col("flush_low")), no)
    back = F.coalesce((left >= 1) & (F.col("close") > F.col("vwap")), no)
    strong = back & F.coalesce((left >= 2) & (F.col("volume") > F.col("volume_b")) & (F.col("close") > F.col("close_b")), no)
    stage = F.when(back, "reclaim").when(stall, "stall").when(flush, "flush").otherwise("none")
    return g.select("symbol", "session", flush.alias("flush"), stall.alias("stall"), back.alias("reclaimed"), strong.alias("strong"), stage.alias("stage"))
