"""Parsing of small source files and configuration relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coerce_numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as doubles; rows with one that is no number are dropped."""
    for c in columns:
        rows = rows.withColumn(c, F.expr(f"try_cast(`{c}` as double)"))
    return rows.dropna(subset=columns)


def positioning_label(net: Column) -> Column:
    return F.when(net >= 0.20, "crowded_long").when(net <= -0.20, "crowded_short").when(net.isNotNull(), "neutral")


def parse_positioning(lines: DataFrame, contract: str) -> DataFrame:
    """lines (value): comma-separated rows; fields 7, 14 and 15 of the contract's row -> net, label."""
    fields = F.split("value", ",")
    number = lambda i: F.expr(f"try_cast(trim(try_element_at(split(value, ','), {i + 1})) as double)")
    row = lines.where(F.col("value").contains(contract) & (F.size(fields) > 15))
    net = F.when(number(7) > 0, (number(14) - number(15)) / number(7))
    return row.select(net.alias("net")).select("net", positioning_label(F.col("net")).alias("label"))


def put_call_label(ratio: Column) -> Column:
    return F.when(ratio >= 1.0, "fear").when(ratio <= 0.6, "greed").when(ratio.isNotNull(), "neutral")


def parse_put_call(lines: DataFrame) -> DataFrame:
    """lines (n, value) in file order: the last data row behind the header with a ratio column -> ratio, label."""
    header = lines.where(F.upper("value").contains("P/C") | F.upper("value").contains("RATIO")).agg(F.min("n").alias("h"))
    ratio = F.expr("try_cast(trim(try_element_at(split(value, ','), 5)) as double)")
    rows = lines.crossJoin(F.broadcast(header)).where("n > h").withColumn("ratio", ratio).where("ratio is not null")  # header: one row
    last = rows.agg(F.max_by("ratio", "n").alias("ratio"))
    return last.select("ratio", put_call_label(F.col("ratio")).alias("label"))


def parse_event_calendar(html: DataFrame) -> DataFrame:
    """html (year, panel): month names and day ranges such as `28-29*` of a year's panel -> year, month, day, starred.

    A panel with different counts of months and days is an error; the last day of a range counts,
    in the next month if it is smaller than the first.
    """
    names = "January February March April May June July August September October November December".split()
    months = F.regexp_extract_all("panel", F.lit(f"({'|'.join(names)})"), 1)
    days = F.regexp_extract_all("panel", F.lit(r"(\d{1,2}-\d{1,2}\*?|\b\d{1,2}\*?(?=<))"), 1)
    checked = html.withColumn("m", months).withColumn("d", days)
    checked = checked.withColumn("ok", F.assert_true(F.size("m") == F.size("d"), F.lit("months and days differ"))).where("ok is null")
    one = checked.select("year", F.explode(F.arrays_zip("m", "d")).alias("z")).select("year", F.col("z.m").alias("m"), F.col("z.d").alias("d"))
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("m")).cast("int")
    first, last = F.regexp_extract("d", r"^(\d+)", 1).cast("int"), F.regexp_extract("d", r"(\d+)\*?$", 1).cast("int")
    month = number + F.when(last < first, 1).otherwise(0)
    return one.select(F.when(month > 12, F.col("year") + 1).otherwise(F.col("year")).alias("year"), ((month - 1) % 12 + 1).alias("month"), last.alias("day"), F.col("d").endswith("*").alias("starred"))


def merge_year(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries of the years in fresh replace old ones."""
    return old.join(fresh.select("year").distinct(), "year", "left_anti").unionByName(fresh)


def universe_merge(parts: list[DataFrame]) -> DataFrame:
    """ticker, src: union of the parts, of each ticker the first part it occurs in."""
    tagged = parts[0].withColumn("src", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        tagged = tagged.unionByName(p.withColumn("src", F.lit(i)))
    return tagged.groupBy("ticker").agg(F.min("src").alias("src"))


def resolve_benchmarks(symbols: DataFrame, peers: DataFrame, common: dict[str, str]) -> DataFrame:
    """symbol, kind, benchmark: the common ones for every symbol, and its peer if there is one."""
    out = None
    for kind, ticker in common.items():
        part = symbols.select("symbol", F.lit(kind).alias("kind"), F.lit(ticker).alias("benchmark"))
        out = part if out is None else out.unionByName(part)
    peer = symbols.join(F.broadcast(peers), "symbol").where("peer is not null").select("symbol", F.lit("peer").alias("kind"), F.col("peer").alias("benchmark"))
    return out.unionByName(peer)


def override_today(bars: DataFrame, today: DataFrame) -> DataFrame:
    """bars (symbol, date, close, volume) with today's (symbol, date, close) in place of that bar; its volume is null."""
    kept = bars.join(today.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return kept.unionByName(today.select("symbol", "date", "close", F.lit(None).cast("double").alias("volume")))


def shape_ohlcv(raw: DataFrame) -> DataFrame:
    """Lower-case column names, bars without a close dropped, NaN turned to null."""
    rows = raw.toDF(*[c.lower() for c in raw.columns])
    doubles = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")]
    rows = rows.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
    return rows.dropna(subset=["close"])


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by order."""
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order))))
    return ranked.where("__r = 1").drop("__r")
