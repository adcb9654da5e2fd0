"""Technical indicators and their readings: RSI, MACD, ATR, volume, shelves, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.windows import ewm, rolling, series, trailing, true_range


def rsi(bars: DataFrame, alpha: float = 1 / 14) -> DataFrame:
    """bars with rsi_a (no losses: 100, no moves: null) and rsi_b (no losses: 50)."""
    x = bars.withColumn("__d", F.col("close") - F.lag("close").over(series()))
    x = x.withColumn("__u", F.when(F.col("__d").isNotNull(), F.greatest(F.col("__d"), F.lit(0.0)))).withColumn("__n", F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), F.lit(0.0))))
    x = ewm(ewm(x, "__u", alpha, "__up"), "__n", alpha, "__dn")
    ratio = 100 - 100 / (1 + F.try_divide("__up", "__dn"))
    a = F.when((F.col("__dn") == 0) & (F.col("__up") == 0), F.lit(None)).when(F.col("__dn") == 0, 100.0).otherwise(ratio)
    return x.withColumn("rsi_a", a).withColumn("rsi_b", F.coalesce(ratio, F.lit(50.0))).drop("__d", "__u", "__n", "__up", "__dn")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, sign: int = 9) -> DataFrame:
    x = ewm(ewm(bars, "close", 2 / (fast + 1), "__f"), "close", 2 / (slow + 1), "__s")
    x = ewm(x.withColumn("macd", F.col("__f") - F.col("__s")), "macd", 2 / (sign + 1), "signal")
    return x.withColumn("histogram", F.col("macd") - F.col("signal")).drop("__f", "__s")


def atr(bars: DataFrame) -> DataFrame:
    return ewm(bars.withColumn("__tr", true_range()), "__tr", 1 / 14, "atr").drop("__tr")


def cross_state(c: str) -> Column:
    before = F.lag(c).over(series())
    return F.when((before <= 0) & (F.col(c) > 0), "bullish").when((before >= 0) & (F.col(c) < 0), "bearish").otherwise("none")


def tail_rank(key: str = "symbol", order: str = "date") -> Column:
    """1 for a symbol's last row, 2 for the one before, ..."""
    return F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))


def swing_lows(bars: DataFrame, side: int = 5, tail: int = 60, most: int = 2) -> DataFrame:
    """symbol, date, low, rk: the last lows that are least of side bars each way, inside the tail only."""
    x = bars.withColumn("m", F.min("low").over(series().rowsBetween(-side, side))).withColumn("back", tail_rank())
    x = x.where((F.col("low") == F.col("m")) & F.col("back").between(side + 1, tail - side)).withColumn("rk", tail_rank())
    return x.where(F.col("rk") <= most).select("symbol", "date", "low", "rk")


def volume_regime(bars: DataFrame, n: int = 20, band: float = 1.15) -> DataFrame:
    """symbol -> up_rel, down_rel (volume on up and down bars over the average of the last n) and signature."""
    x = bars.withColumn("back", tail_rank()).where(F.col("back") <= n)
    up = F.col("close") >= F.col("open")
    g = x.groupBy("symbol").agg(F.avg("volume").alias("v"), F.avg(F.when(up, F.col("volume"))).alias("u"), F.avg(F.when(~up, F.col("volume"))).alias("w"))
    g = g.select("symbol", F.try_divide("u", "v").alias("up_rel"), F.try_divide("w", "v").alias("down_rel"))
    signature = (
        F.when((F.col("up_rel") >= band * F.col("down_rel")) & (F.col("up_rel") >= 1.0), "accumulation")
        .when((F.col("down_rel") >= band * F.col("up_rel")) & (F.col("down_rel") >= 1.0), "distribution")
        .otherwise("balanced")
    )
    return g.withColumn("signature", signature)


def down_day_forensics(bars: DataFrame) -> DataFrame:
    """symbol -> ratio of the last 10 bars' mean down volume to the mean volume of bars 63 to 11 back, label."""
    x = bars.withColumn("back", tail_rank()).withColumn("down", F.col("close") < F.lag("close").over(series()))
    g = x.where("back <= 63").groupBy("symbol").agg(
        F.avg(F.when((F.col("back") <= 10) & F.col("down"), F.col("volume"))).alias("recent"), F.avg(F.when(F.col("back") > 10, F.col("volume"))).alias("base")
    )
    ratio = F.try_divide("recent", "base")
    return g.select("symbol", ratio.alias("ratio"), F.when(ratio >= 1.3, "capitulation").when(ratio <= 0.8, "distribution").when(ratio.isNotNull(), "neutral").alias("label"))


def down_volume_ratio(bars: DataFrame, lookback: int = 10, base: int = 50) -> DataFrame:
    """symbol -> ratio of the last `lookback` bars' mean volume on down days to the mean volume of the `base` bars before; of symbols
    with as many bars as both, null without a down day or a base."""
    x = bars.withColumn("back", tail_rank()).withColumn("down", F.col("close") < F.lag("close").over(series()))
    g = x.groupBy("symbol").agg(
        F.avg(F.when((F.col("back") <= lookback) & F.col("down"), F.col("volume"))).alias("recent"),
        F.avg(F.when((F.col("back") > lookback) & (F.col("back") <= lookback + base), F.col("volume"))).alias("base"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.where(F.col("n") >= lookback + base).select("symbol", F.try_divide("recent", F.nullif("base", F.lit(0.0))).alias("ratio"))


def up_down_volume(bars: DataFrame, n: int = 10) -> DataFrame:
    """symbol, date, ratio: volume on rising over volume on falling days of the last n; and the value five bars ago."""
    w = series()
    x = bars.withColumn("d", F.col("close") - F.lag("close").over(w))
    up, dn = F.sum(F.when(F.col("d") >= 0, F.col("volume"))).over(trailing(n)), F.sum(F.when(F.col("d") < 0, F.col("volume"))).over(trailing(n))
    x = x.withColumn("ratio", F.when((F.count("d").over(trailing(n)) >= n) & (dn > 0), F.coalesce(up, F.lit(0.0)) / dn))
    return x.select("symbol", "date", "ratio", F.lag("ratio", 5).over(w).alias("ratio_5_ago"))


def volume_shelves(bars: DataFrame, tail: int = 90, bins: int = 24, quantile: float = 0.8) -> DataFrame:
    """symbol, bin, price, share, is_shelf, rk: volume of the last bars spread evenly over the price bins each covers.

    Bins without volume count for the quantile. A bar without range goes to its close's bin.
    """
    x = bars.withColumn("back", tail_rank()).where(F.col("back") <= tail)
    span = x.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = lambda p: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(p - F.col("lo"), width)), F.lit(0)))).cast("int")
    x = x.join(span, "symbol").withColumn("a", F.when(F.col("high") > F.col("low"), at(F.col("low"))).otherwise(at(F.col("close"))))
    x = x.withColumn("b", F.when(F.col("high") > F.col("low"), at(F.col("high"))).otherwise(F.col("a")))
    hit = x.withColumn("bin", F.explode(F.sequence("a", "b"))).groupBy("symbol", "bin").agg(F.sum(F.col("volume") / (F.col("b") - F.col("a") + 1)).alias("v"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(hit, ["symbol", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    by = W.partitionBy("symbol")
    full = full.withColumn("share", F.try_divide("v", F.sum("v").over(by))).withColumn("cut", F.percentile("v", quantile).over(by))
    shelf = (F.col("v") >= F.col("cut")) & (F.col("v") > 0)
    price = F.col("lo") + (F.col("bin") + 0.5) * width
    rk = F.row_number().over(by.orderBy(F.desc("v"), "bin"))
    return full.select("symbol", "bin", price.alias("price"), "share", shelf.alias("is_shelf"), rk.alias("rk"))


def reclaim(bars: DataFrame, window: int = 13) -> DataFrame:
    """symbol -> reclaimed, strong: the last bars start below the 50-bar average, end above it, and hold since the last cross."""
    x = bars.withColumn("ma50", rolling(F.avg, "close", 50)).withColumn("up", F.coalesce(F.col("close") >= F.col("ma50"), F.lit(False)))
    x = x.withColumn("vol50", F.avg("volume").over(series().rowsBetween(-50, -1))).withColumn("back", tail_rank()).where(F.col("back") <= window)
    crossed = F.col("up") & ~F.coalesce(F.lag("up").over(series()), F.lit(True))
    x = x.withColumn("cross", crossed)
    g = x.groupBy("symbol").agg(
        F.max_by("up", "back").alias("first_up"), F.min_by("up", "back").alias("last_up"), F.min(F.when(F.col("cross"), F.col("back"))).alias("at"),
        F.min_by("volume", F.when(F.col("cross"), F.col("back"))).alias("v"), F.min_by("vol50", F.when(F.col("cross"), F.col("back"))).alias("v50"),
    )
    ok = ~F.col("first_up") & F.col("last_up") & F.col("at").isNotNull()
    return g.select("symbol", ok.alias("reclaimed"), (ok & F.coalesce(F.col("v") >= F.col("v50"), F.lit(True))).alias("strong"))


def technical_read(bars: DataFrame) -> DataFrame:
    """The last row of each symbol with its readings: trend against both averages and their order, momentum, levels, vote."""
    x = atr(macd(rsi(bars)))
    for n in (50, 200):
        x = x.withColumn(f"ma{n}", rolling(F.avg, "close", n))
    w = series()
    x = x.withColumn("res50", rolling(F.max, "high", 50)).withColumn("sup50", rolling(F.min, "low", 50)).withColumn("macd_rising", F.coalesce(F.col("histogram") > F.lag("histogram").over(w), F.lit(False)))
    diverges = (F.col("close") > F.lag("close", 39).over(w)) & (F.col("rsi_a") < F.lag("rsi_a", 39).over(w)) & (F.col("rsi_a") < 60)
    x = x.withColumn("divergence", F.coalesce(diverges, F.lit(False))).withColumn("back", tail_rank()).where("back = 1")
    a, b, g = F.col("close") >= F.col("ma50"), F.col("close") >= F.col("ma200"), F.col("ma50") >= F.col("ma200")
    short = F.when(a, "uptrend").otherwise("downtrend")
    trend = F.when(F.col("ma50").isNull(), "unknown").when(F.col("ma200").isNull(), short).when(a & b & g, "uptrend").when(~a & ~b & ~g, "downtrend").otherwise("mixed")
    x = x.withColumn("trend", trend)
    vote = F.when(F.col("trend") == "uptrend", "BUY").when(F.col("trend") == "downtrend", "AVOID").otherwise("WAIT")
    return x.select("symbol", "date", "close", "trend", "rsi_a", "rsi_b", "histogram", "macd_rising", "divergence", "atr", "res50", "sup50", vote.alias("vote"))
