"""Daily, intraday and macro series derived from the driver's tables.

The driver's tables hold no market prices, so these proxies only exercise semantics:
bars are aggregated from lineitem by day, the volatility and credit series from its
discounts and taxes, intraday bars from events. Averages are taken over whole cents and
cut to four or six decimals in integers, so every later number starts from equal inputs
whatever the order of aggregation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean(c: str, factor: int, decimals: int):
    """factor * average of a column with two decimals, cut to so many decimals, by integers."""
    cents = f"sum(cast(round({c} * 100) as bigint)) * {factor * 10**decimals // 100} div count({c})"
    return F.expr(f"({cents}) / {10**decimals}d")


def _ohlcv(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.groupBy(*keys).agg(
        F.round(F.min(order)["l_extendedprice"], 4).alias("open"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        _mean("l_extendedprice", 1, 4).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: one symbol per return flag and line status."""
    rows = table(spark, sf_dir, "lineitem").withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    return _ohlcv(rows.withColumn("date", F.to_date("l_shipdate")), ["symbol", "date"])


def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by part brand, for cross-sectional plans (25 symbols)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _ohlcv(rows.withColumn("date", F.to_date("l_shipdate")), ["symbol", "date"])


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, bench: the average price of all lines of a day."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.to_date("l_shipdate").alias("date")).agg(_mean("l_extendedprice", 1, 4).alias("bench"))


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, vix: a volatility proxy on its own calendar."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return rows.groupBy(F.to_date("l_shipdate").alias("date")).agg(_mean("l_discount", 400, 6).alias("vix"))


def credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, credit: a credit-spread proxy."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.to_date("l_shipdate").alias("date")).agg(_mean("l_tax", 50, 6).alias("credit"))


class Market(NamedTuple):
    """Daily series that plans read many times."""

    bars: DataFrame
    bench: DataFrame
    vix: DataFrame
    credit: DataFrame


def stored_market(spark: SparkSession, sf_dir: str) -> Market:
    """The same series as daily_bars, benchmark, vix and credit give, from one pass over lineitem.

    Each symbol's day is reduced once, with the sums that the other series need, and written; all
    later reading is of that small table.
    """
    cents = lambda c: F.expr(f"sum(cast(round({c} * 100) as bigint))")
    first = F.col("l_linenumber") == 1
    rows = table(spark, sf_dir, "lineitem").withColumn("symbol", F.concat("l_returnflag", "l_linestatus")).withColumn("date", F.to_date("l_shipdate"))
    rows = rows.withColumn("__d", F.when(first, F.col("l_discount"))).withColumn("__l", first)
    sums = {"price": "l_extendedprice", "tax": "l_tax", "disc": "__d"}
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    days = rows.groupBy("symbol", "date").agg(
        F.round(F.min(order)["l_extendedprice"], 4).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.sum("l_quantity").alias("volume"), F.max("__l").alias("has_first"),
        *[x for n, c in sums.items() for x in (cents(c).alias(f"{n}_cents"), F.count(c).alias(f"{n}_n"))],
    )
    days = stored(days, "days")

    def mean(n: str, factor: int, decimals: int, total: str = "sum({})"):
        c, k = total.format(f"{n}_cents"), total.format(f"{n}_n")
        return F.expr(f"({c} * {factor * 10**decimals // 100} div {k}) / {10**decimals}d")

    by_day = days.groupBy("date")
    bars = days.select("symbol", "date", "open", "high", "low", mean("price", 1, 4, "{}").alias("close"), "volume")
    return Market(
        bars,
        by_day.agg(mean("price", 1, 4).alias("bench")),
        days.where("has_first").groupBy("date").agg(mean("disc", 400, 6).alias("vix")),
        by_day.agg(mean("tax", 50, 6).alias("credit")),
    )


def intraday_bars(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    """symbol, bar_ts (start), session, open, high, low, close, volume from events."""
    rows = table(spark, sf_dir, "events")
    start = F.window("ts", f"{minutes} minutes")["start"]
    bars = rows.groupBy(F.col("event_type").alias("symbol"), start.alias("bar_ts")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars.withColumn("session", F.to_date("bar_ts"))


#: The same relations in DuckDB SQL, as common table expressions.
def _sql_mean(c: str, factor: int, decimals: int) -> str:
    return f"(sum(round({c} * 100)::BIGINT)::BIGINT * {factor * 10**decimals // 100} // count({c})) / {10**decimals}::DOUBLE"


_SQL_OHLCV = f"""round(min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice)).e, 4) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low, {_sql_mean('l_extendedprice', 1, 4)} AS close, sum(l_quantity) AS volume"""
SQL_BARS = f"bars AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::DATE AS date, {_SQL_OHLCV} FROM lineitem GROUP BY 1, 2)"
SQL_PANEL = f"panel AS (SELECT p_brand AS symbol, l_shipdate::DATE AS date, {_SQL_OHLCV} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
SQL_BENCH = f"bench AS (SELECT l_shipdate::DATE AS date, {_sql_mean('l_extendedprice', 1, 4)} AS bench FROM lineitem GROUP BY 1)"
SQL_VIX = f"vix AS (SELECT l_shipdate::DATE AS date, {_sql_mean('l_discount', 400, 6)} AS vix FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"
SQL_CREDIT = f"credit AS (SELECT l_shipdate::DATE AS date, {_sql_mean('l_tax', 50, 6)} AS credit FROM lineitem GROUP BY 1)"
SQL_INTRADAY = """intraday AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 15 minutes, ts) AS bar_ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume, time_bucket(INTERVAL 15 minutes, ts)::DATE AS session
  FROM events GROUP BY ALL)"""
