"""Queries: store and ledger round trips, positions, and the remaining scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.windows import position, rolling, series
from tidemark.plans import ledger as L
from tidemark.plans.query_indicators import B, CR, SW, _ma
from tidemark.plans.registry import query
from tidemark.sources import files, pit, scratch
from tidemark.sources import market as M


def scratch_root(spark: SparkSession) -> str:
    return scratch.folder(spark, "store")


@query("io01_io03_io27_price_store", f"WITH {B} SELECT date, open, high, low, close, volume FROM bars WHERE symbol = 'NO' AND date <= DATE '1998-03-31'", "open high low close volume", places=4)
def price_store(spark, d):
    root = scratch_root(spark)
    pit.write_prices(M.daily_bars(spark, d), root)
    return pit.PointInTimeContext(spark, root, "1998-03-31").ohlcv("NO").select("date", "open", "high", "low", "close", "volume")


@query("io02_macro_store", f"WITH {CR} SELECT date, credit AS value FROM credit WHERE date <= DATE '1998-03-31'", "value")
def macro_store(spark, d):
    root = scratch_root(spark)
    pit.write_macro(M.credit(spark, d).select(F.lit("CREDIT").alias("series"), F.col("date").alias("effective_date"), F.col("credit").alias("value")), root)
    return pit.PointInTimeContext(spark, root, "1998-03-31").macro("CREDIT")


@query("io10_lookahead_assertion", f"WITH {B} SELECT symbol, date FROM bars WHERE date <= DATE '1997-01-31'")
def lookahead(spark, d):
    rows = M.daily_bars(spark, d).where("date <= '1997-01-31'").select("symbol", "date")
    return pit.assert_no_lookahead(rows, "1997-01-31")


@query("io12_shape_ohlcv", f"WITH {B} SELECT symbol, date, close FROM bars WHERE day(date) <> 7", "close", places=4)
def shaped(spark, d):
    raw = M.daily_bars(spark, d).select(F.col("symbol").alias("SYMBOL"), F.col("date").alias("Date"), F.when(F.dayofmonth("date") == 7, float("nan")).otherwise(F.col("close")).alias("Close"))
    return files.shape_ohlcv(raw)


@query("io18_ledger_append", f"WITH {B} SELECT count(*)::BIGINT AS n FROM bars")
def append(spark, d):
    led = L.Ledger(spark, scratch_root(spark))
    f = M.daily_bars(spark, d).select(F.concat_ws("-", "symbol", "date").alias("forecast_id"), F.col("symbol").alias("ticker"), F.col("date").alias("trading_date"), F.lit(5).alias("horizon"), F.lit("v").alias("voter"))
    led.append_new("forecasts", f.where("ticker = 'NO'"), "forecast_id")
    led.append_new("forecasts", f, "forecast_id")  # what is there stays once
    return led.table("forecasts").agg(F.count(F.lit(1)).alias("n"))


@query("io19_write_ahead", "SELECT event_id % 100 AS write_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def write_ahead(spark, d):
    path = f"{scratch_root(spark)}/staged"
    ev = M.table(spark, d, "events")
    for part in (0, 1):  # appended before each attempt, read back as a queue
        ev.where(F.col("event_id") % 2 == part).select((F.col("event_id") % 100).alias("write_id"), F.lit(0).alias("attempts")).write.mode("append").json(path)
    return spark.read.schema("write_id long, attempts int").json(path).groupBy("write_id").agg(F.count(F.lit(1)).alias("n"))


@query("w01_w02_w03_positions", f"WITH {B} SELECT symbol, date, row_number() OVER w - 1 AS pos, lag(close, 3) OVER w AS back3, lead(close, 3) OVER w AS ahead3, {_ma(10, 'close', 'max', 4)} AS max10 FROM bars {SW}", "back3 ahead3 max10", places=4)
def positions(spark, d):
    w = series()
    return M.daily_bars(spark, d).select("symbol", "date", position().alias("pos"), F.lag("close", 3).over(w).alias("back3"), F.lead("close", 3).over(w).alias("ahead3"), rolling(F.max, "close", 10, 4).alias("max10"))


@query(
    "f06_f09_f10_strength",
    """SELECT o_orderkey, (o_orderkey % 4 < 2) OR (o_orderkey % 500 < 365) AS concentrated,
      CASE WHEN o_orderkey % 101 >= 50 THEN CASE WHEN abs(o_orderkey % 101 - 50) * 2 >= 90 THEN 'hot' WHEN abs(o_orderkey % 101 - 50) * 2 >= 60 THEN 'warm' ELSE 'normal' END WHEN abs(o_orderkey % 101 - 50) * 2 >= 60 THEN 'cooling' ELSE 'normal' END AS state,
      least(1.0, (o_orderkey % 20) / 12.0) * (0.5 + 0.5 * abs(o_orderkey % 101 - 50) / 50.0) * 100 * CASE WHEN o_orderkey % 2 = 0 THEN 0.7 ELSE 1 END AS confidence FROM orders""",
    "confidence",
)
def strength(spark, d):
    k = F.col("o_orderkey")
    pct = (k % 101).cast("double")
    first = F.lit("2000-01-01").cast("date")
    return M.table(spark, d, "orders").select(
        "o_orderkey", S.is_concentrated(k % 4, first, F.date_add(first, (k % 500).cast("int"))).alias("concentrated"), S.percentile_state(pct).alias("state"), S.strength_confidence(k % 20, pct, k % 2 == 0).alias("confidence"),
    )


@query(
    "f12_f17_f19_outcome_scalars",
    """SELECT o_orderkey, 0.03 / ((o_orderkey % 9 + 1) / 100.0 * sqrt(5 / 252.0)) AS per_vol, (o_orderkey % 7) / 10.0 - 0.3 BETWEEN -0.1 AND 0.2 AS covered, abs(o_orderkey % 30 / 100.0 - 0.15) >= 0.10 OR o_orderkey % 90 >= 63 AS rebase,
      date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS drift, ('0x' || substr(sha256(o_orderkey || '|x'), 1, 15))::BIGINT % 7 AS draw FROM orders""",
    "per_vol",
)
def outcome_scalars(spark, d):
    k = F.col("o_orderkey")
    return M.table(spark, d, "orders").select(
        "o_orderkey", S.return_per_vol(F.lit(0.03), (k % 9 + 1) / 100.0, F.lit(5)).alias("per_vol"), S.interval_covered((k % 7) / 10.0 - 0.3, F.lit(-0.1), F.lit(0.2)).alias("covered"),
        S.needs_rebaseline(k % 30 / 100.0 - 0.15, k % 90).alias("rebase"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("drift"), (S.seed60(k, F.lit("x")) % 7).alias("draw"),
    )
