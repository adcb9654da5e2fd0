"""Queries: sources, indicators, alignment, regimes, thinning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alignment, regimes, thinning
from tidemark.operators.windows import (
    ewm,
    n_bar_return,
    percent_rank_average,
    position,
    rolling,
    series,
    trailing,
    true_range,
    with_runs,
    with_streak,
)
from tidemark.plans import studies
from tidemark.plans.registry import query
from tidemark.plans.technicals import atr, macd, rsi
from tidemark.sources import market as M
from tidemark.sources.scratch import stored

B, P, BE, VX, CR, IN = M.SQL_BARS, M.SQL_PANEL, M.SQL_BENCH, M.SQL_VIX, M.SQL_CREDIT, M.SQL_INTRADAY
SW = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


# ---- sources

@query("io04_daily_bars", f"WITH {B} SELECT * FROM bars", "open high low close volume", places=4)
def daily(spark, d):
    return M.daily_bars(spark, d)


@query("io05_asof_scan", f"WITH {B} SELECT symbol, max(date) AS last_date, count(*) AS n, max(close) AS max_close FROM bars WHERE date <= DATE '1997-06-30' GROUP BY symbol", "max_close")
def asof_scan(spark, d):
    from tidemark.sources.pit import as_of

    rows = M.daily_bars(spark, d).withColumn("processed_date", F.col("date"))
    return as_of(rows, "1997-06-30").groupBy("symbol").agg(F.max("date").alias("last_date"), F.count("*").alias("n"), F.max("close").alias("max_close"))


@query(
    "io05_publication_lag",
    f"""WITH {CR}, l AS (SELECT date AS effective_date, date + INTERVAL 2 DAY AS processed_date, credit AS value FROM credit)
    SELECT max(effective_date)::DATE AS last_effective, count(*) AS n FROM l WHERE processed_date <= DATE '1998-01-10'""",
)
def publication_lag(spark, d):
    from tidemark.sources.pit import as_of

    lagged = M.credit(spark, d).select(F.col("date").alias("effective_date"), F.date_add("date", 2).alias("processed_date"), F.col("credit").alias("value"))
    return as_of(lagged, "1998-01-10").agg(F.max("effective_date").alias("last_effective"), F.count("*").alias("n"))


@query(
    "io09_context_no_lookahead",
    f"WITH {B} SELECT symbol, count(*) AS n, max(date) <= DATE '1996-03-31' AS clean FROM bars WHERE date <= DATE '1996-03-31' GROUP BY symbol",
)
def no_lookahead(spark, d):
    from tidemark.sources.pit import as_of

    rows = as_of(M.daily_bars(spark, d).withColumn("processed_date", F.col("date")), "1996-03-31")
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), (F.max("date") <= F.lit("1996-03-31").cast("date")).alias("clean"))


@query("io11_coerce_numeric", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL", "k")
def coerce(spark, d):
    from tidemark.sources.files import coerce_numeric

    rows = M.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return coerce_numeric(rows, ["k"])


_LONG, _SHORT = "o_custkey", "(o_orderkey % 30000)"


@query(
    "io13_positioning",
    f"""SELECT net, CASE WHEN net >= 0.2 THEN 'crowded_long' WHEN net <= -0.2 THEN 'crowded_short' WHEN net IS NOT NULL THEN 'neutral' END AS label
    FROM (SELECT CASE WHEN o_totalprice > 0 THEN ({_LONG} - {_SHORT}) / o_totalprice END AS net FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "net",
)
def positioning(spark, d):
    """A report line for each order, of which those of one contract are parsed."""
    from tidemark.sources.files import parse_positioning

    blank = [F.lit(" x")] * 16
    blank[0], blank[7], blank[14], blank[15] = F.col("o_orderpriority"), F.col("o_totalprice").cast("string"), F.concat(F.lit(" "), F.expr(_LONG)), F.expr(_SHORT).cast("string")
    lines = M.table(spark, d, "orders").select(F.concat_ws(",", *blank).alias("value"))
    return parse_positioning(lines.unionByName(spark.sql("SELECT '1-URGENT,too,short' AS value")), "1-URGENT")


@query(
    "io14_put_call",
    "SELECT ratio, CASE WHEN ratio >= 1.0 THEN 'fear' WHEN ratio <= 0.6 THEN 'greed' ELSE 'neutral' END AS label FROM (SELECT arg_max(value, event_id) / 100 AS ratio FROM events WHERE event_id % 7 <> 0)",
    "ratio",
)
def put_call(spark, d):
    """A file of one line for each event, some without a ratio, behind a title and a header."""
    from tidemark.sources.files import parse_put_call

    ratio = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("value") / 100).cast("string"))
    lines = M.table(spark, d, "events").select(F.col("event_id").alias("n"), F.concat_ws(",", F.lit("01/02/2024"), F.lit("1"), F.lit("2"), F.lit("3"), ratio).alias("value"))
    head = spark.sql("SELECT * FROM VALUES (-3L, 'Exchange volume,,,,9.9'), (-2L, 'DATE,CALLS,PUTS,TOTAL,P/C Ratio') AS t(n, value)")
    return parse_put_call(lines.unionByName(head))


@query(
    "io15_event_calendar",
    """WITH p AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, min(day(o_orderdate)) AS a, max(day(o_orderdate)) AS b FROM orders GROUP BY ALL)
    SELECT (y + CASE WHEN m = 12 AND m % 4 = 0 AND a < b THEN 1 ELSE 0 END)::INT AS year, (CASE WHEN m % 4 = 0 AND a < b THEN m % 12 + 1 ELSE m END)::INT AS month,
      (CASE WHEN m % 4 = 0 THEN a ELSE b END)::INT AS day, m % 3 = 0 AS starred FROM p""",
)
def event_calendar(spark, d):
    """A year's panel of months and day ranges, for every year of orders; every fourth range ends in the next month."""
    from tidemark.sources.files import parse_event_calendar

    names = F.array(*[F.lit(x) for x in "January February March April May June July August September October November December".split()])
    day = F.dayofmonth("o_orderdate")
    per = M.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    turned = F.col("m") % 4 == 0
    days = F.concat_ws("-", F.when(turned, F.col("b")).otherwise(F.col("a")).cast("string"), F.when(turned, F.col("a")).otherwise(F.col("b")).cast("string"))
    cell = F.concat(F.lit("<b>"), F.element_at(names, F.col("m")), F.lit("</b><td>"), days, F.when(F.col("m") % 3 == 0, "*").otherwise(""), F.lit("</td>"))
    cells = F.sort_array(F.collect_list(F.struct("m", cell.alias("c"))))  # twelve at most
    return parse_event_calendar(per.groupBy("year").agg(F.array_join(F.transform(cells, lambda x: x["c"]), "").alias("panel")))


@query(
    "io15_html_links",
    r"""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::BIGINT AS n_links,
      coalesce(list_aggregate(regexp_extract_all(html, '<a href="([^"]*)"', 1), 'max'), '') AS last_link FROM pages""",
)
def html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return M.table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.coalesce(F.array_max(links), F.lit("")).alias("last_link"))


@query(
    "io16_config_merge",
    """WITH old AS (SELECT DISTINCT year(o_orderdate) AS year, o_orderpriority AS note FROM orders),
      fresh AS (SELECT DISTINCT year(o_orderdate) AS year, 'new' AS note FROM orders WHERE year(o_orderdate) = 1997)
    SELECT year, note FROM old WHERE year NOT IN (SELECT year FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def config_merge(spark, d):
    from tidemark.sources.files import merge_year

    orders = M.table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("note")).distinct()
    fresh = orders.where("year = 1997").select("year", F.lit("new").alias("note")).distinct()
    return merge_year(orders, fresh)


@query(
    "io20_staged_writes",
    """WITH q AS (SELECT event_id % 500 AS write_id, (event_id % 7)::INT AS attempts, event_id, event_id % 3 = 0 AS ok FROM events),
      d AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY write_id ORDER BY event_id DESC) = 1)
    SELECT write_id, CASE WHEN ok THEN attempts ELSE attempts + 1 END AS attempts,
      CASE WHEN ok THEN 'persisted' WHEN attempts + 1 >= 5 THEN 'dead_letter' ELSE 'staged' END AS state FROM d""",
)
def staged(spark, d):
    from tidemark.plans.ledger import advance_staged

    ev = M.table(spark, d, "events")
    rows = ev.select((F.col("event_id") % 500).alias("write_id"), (F.col("event_id") % 7).cast("int").alias("attempts"), F.col("event_id").alias("queued"), (F.col("event_id") % 3 == 0).alias("ok"))
    latest = rows.withColumn("r", F.row_number().over(W.partitionBy("write_id").orderBy(F.desc("queued")))).where("r = 1")
    results = latest.select("write_id", "ok")
    return advance_staged(latest.select("write_id", "attempts", "queued"), results).select("write_id", "attempts", "state")


@query(
    "io21_write_id",
    "SELECT o_orderkey, 'create:' || substr(sha256('C' || o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || '20' || '|' || '' || '|' || o_orderstatus), 1, 16) AS write_id FROM orders",
)
def write_id(spark, d):
    o = M.table(spark, d, "orders")
    return o.select("o_orderkey", S.write_id("create", F.concat(F.lit("C"), F.col("o_custkey")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("20"), F.lit(None), F.col("o_orderstatus")).alias("write_id"))


@query("io22_rng_seed", "SELECT c_custkey, ('0x' || substr(sha256(c_name || '|7'), 1, 15))::BIGINT AS seed FROM customer")
def rng_seed(spark, d):
    return M.table(spark, d, "customer").select("c_custkey", S.seed60(F.col("c_name"), F.lit("7")).alias("seed"))


@query(
    "io23_s04_universe_merge",
    """WITH u AS (SELECT p_brand AS ticker, 0 AS src FROM part UNION ALL SELECT p_type, 1 FROM part UNION ALL SELECT p_brand, 2 FROM part)
    SELECT ticker, min(src)::INT AS src FROM u GROUP BY ticker""",
)
def universe(spark, d):
    from tidemark.sources.files import universe_merge

    part = M.table(spark, d, "part")
    return universe_merge([part.select(F.col("p_brand").alias("ticker")), part.select(F.col("p_type").alias("ticker")), part.select(F.col("p_brand").alias("ticker"))])


@query(
    "io24_benchmarks",
    f"WITH {B}, s AS (SELECT DISTINCT symbol FROM bars), m(symbol, peer) AS (VALUES ('AF', 'RF'), ('NO', NULL)) "
    "SELECT symbol, 'SPX' AS kind, '*' AS benchmark FROM s UNION ALL SELECT s.symbol, 'peer', peer FROM s JOIN m ON m.symbol = s.symbol WHERE peer IS NOT NULL",
)
def benchmarks(spark, d):
    from tidemark.sources.files import resolve_benchmarks

    symbols = M.daily_bars(spark, d).select("symbol").distinct()
    peers = spark.createDataFrame([("AF", "RF"), ("NO", None)], "symbol string, peer string")
    return resolve_benchmarks(symbols, peers, {"SPX": "*"})


@query(
    "io25_resume_point",
    f"WITH {B}, l AS (SELECT symbol, max(date) AS m FROM bars WHERE date < DATE '1999-01-01' GROUP BY symbol) SELECT b.symbol, count(*) AS n_next, min(b.date) AS next_date FROM bars b JOIN l USING (symbol) WHERE b.date > m GROUP BY b.symbol",
)
def resume(spark, d):
    from tidemark.plans.ledger import after_resume_point

    bars = M.daily_bars(spark, d).select("symbol", F.col("date").alias("trading_date"))
    done = bars.where("trading_date < '1999-01-01'")
    return after_resume_point(bars, done, ["symbol"]).groupBy("symbol").agg(F.count("*").alias("n_next"), F.min("trading_date").alias("next_date"))


@query("io26_trading_dates", f"WITH {B} SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def trading_dates(spark, d):
    return M.daily_bars(spark, d).select("date").where("date between '1996-01-01' and '1996-12-31'").distinct()


# ---- projections

_RET = ", ".join(f"close / lag(close, {n}) OVER w - 1 AS ret_{n}" for n in (1, 5, 20, 60, 63, 120, 252))


@query("p01_returns", f"WITH {B} SELECT symbol, date, {_RET} FROM bars {SW}", " ".join(f"ret_{n}" for n in (1, 5, 20, 60, 63, 120, 252)))
def returns(spark, d):
    return M.daily_bars(spark, d).select("symbol", "date", *[n_bar_return("close", n).alias(f"ret_{n}") for n in (1, 5, 20, 60, 63, 120, 252)])


def _ma(n, c="close", agg="avg", least=None):
    return f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) >= {least or n} THEN {agg}({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) END"


@query("p02_p03_moving_averages", f"WITH {B} SELECT symbol, date, {_ma(20)} AS ma20, {_ma(50)} AS ma50, {_ma(200)} AS ma200, close / ({_ma(200)}) - 1 AS ext200 FROM bars", "ma20 ma50 ma200 ext200", places=4)
def averages(spark, d):
    b = M.daily_bars(spark, d)
    for n in (20, 50, 200):
        b = b.withColumn(f"ma{n}", rolling(F.avg, "close", n))
    return b.select("symbol", "date", "ma20", "ma50", "ma200", (F.col("close") / F.col("ma200") - 1).alias("ext200"))


@query(
    "p04_p05_p06_highs_drawdowns",
    f"WITH {B} SELECT symbol, date, {_ma(252, 'close', 'max', 60)} AS high252, close / ({_ma(252, 'close', 'max', 60)}) - 1 AS drawdown, {_ma(252, 'close', 'max')} AS strict252, close / ({_ma(20, 'close', 'max')}) - 1 AS from_hi20 FROM bars",
    "high252 drawdown strict252 from_hi20",
    places=4,
)
def drawdowns(spark, d):
    b = M.daily_bars(spark, d).withColumn("high252", rolling(F.max, "close", 252, 60)).withColumn("strict252", rolling(F.max, "close", 252)).withColumn("hi20", rolling(F.max, "close", 20))
    return b.select("symbol", "date", "high252", (F.col("close") / F.col("high252") - 1).alias("drawdown"), "strict252", (F.col("close") / F.col("hi20") - 1).alias("from_hi20"))


@query("p07_trailing_returns", f"WITH {B} SELECT symbol, date, close / lag(close, 126) OVER w - 1 AS trail126, close / lag(close, 252) OVER w - 1 AS trail252 FROM bars {SW}", "trail126 trail252")
def trailing_returns(spark, d):
    return M.daily_bars(spark, d).select("symbol", "date", n_bar_return("close", 126).alias("trail126"), n_bar_return("close", 252).alias("trail252"))


@query(
    "p08_relative_return_63",
    f"""WITH {B}, {BE}, j AS (SELECT symbol, date, close, last_value(bench IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS bench FROM bars LEFT JOIN bench USING (date))
    SELECT symbol, date, (close / lag(close, 63) OVER w - 1) - (bench / lag(bench, 63) OVER w - 1) AS rel63 FROM j {SW}""",
    "rel63",
)
def rel63(spark, d):
    j = alignment.reindex_ffill(M.daily_bars(spark, d), M.benchmark(spark, d), "bench")
    return j.select("symbol", "date", (n_bar_return("close", 63) - n_bar_return("bench", 63)).alias("rel63"))


@query(
    "p09_p10_realised_vol",
    f"""WITH {B}, r AS (SELECT symbol, date, close / lag(close) OVER w - 1 AS r FROM bars {SW})
    SELECT symbol, date, {_ma(21, 'r', 'stddev_samp')} * sqrt(252) AS vol21, {_ma(20, 'r', 'stddev_samp')} AS vol20 FROM r""",
    "vol21 vol20",
)
def vols(spark, d):
    r = M.daily_bars(spark, d).withColumn("r", n_bar_return("close", 1))
    return r.select("symbol", "date", (rolling(F.stddev_samp, "r", 21) * F.sqrt(F.lit(252.0))).alias("vol21"), rolling(F.stddev_samp, "r", 20).alias("vol20"))


@query(
    "p11_p12_log_relative",
    f"""WITH {B}, {BE}, j AS (SELECT symbol, date, ln(close) - ln(bench) AS rel FROM bars JOIN bench USING (date))
    SELECT symbol, date, rel, rel - lag(rel, 10) OVER w AS rel10, rel - lag(rel, 63) OVER w AS rel63 FROM j {SW}""",
    "rel rel10 rel63",
)
def log_relative(spark, d):
    j = M.daily_bars(spark, d).join(M.benchmark(spark, d), "date").withColumn("rel", F.ln("close") - F.ln("bench"))
    w = series()
    return j.select("symbol", "date", "rel", (F.col("rel") - F.lag("rel", 10).over(w)).alias("rel10"), (F.col("rel") - F.lag("rel", 63).over(w)).alias("rel63"))


def _ewm_sql(c: str, a: float, rel: str, keep: str) -> str:
    """EWM of column c of relation rel (symbol, date, c), its first non-null value as seed."""
    return (
        f"(SELECT {keep}, CASE WHEN t IS NOT NULL THEN pow(1 - {a}, t) * sum(CASE WHEN t = 0 THEN {c} ELSE {a} * {c} END * pow(1 - {a}, -t)) "
        f"OVER (PARTITION BY symbol ORDER BY date) END AS y FROM (SELECT *, CASE WHEN {c} IS NOT NULL THEN count({c}) OVER (PARTITION BY symbol ORDER BY date) - 1 END AS t FROM {rel}))"
    )


@query(
    "p13_rsi",
    f"""WITH {B}, x AS (SELECT symbol, date, close - lag(close) OVER w AS dd FROM bars {SW}),
      y AS (SELECT symbol, date, greatest(dd, 0) AS up, greatest(-dd, 0) AS dn FROM x WHERE dd IS NOT NULL),
      u AS {_ewm_sql('up', 1 / 14, 'y', 'symbol, date')}, v AS {_ewm_sql('dn', 1 / 14, 'y', 'symbol, date')}
    SELECT b.symbol, b.date, CASE WHEN v.y = 0 AND u.y = 0 THEN NULL WHEN v.y = 0 THEN 100 ELSE 100 - 100 / (1 + u.y / v.y) END AS rsi_a,
      coalesce(CASE WHEN v.y <> 0 THEN 100 - 100 / (1 + u.y / v.y) END, 50) AS rsi_b
    FROM bars b LEFT JOIN u ON u.symbol = b.symbol AND u.date = b.date LEFT JOIN v ON v.symbol = b.symbol AND v.date = b.date""",
    "rsi_a rsi_b",
    places=4,
)
def rsi_query(spark, d):
    return rsi(M.daily_bars(spark, d)).select("symbol", "date", "rsi_a", "rsi_b")


@query(
    "p14_macd",
    f"""WITH {B}, f AS {_ewm_sql('close', 2 / 13, 'bars', 'symbol, date')}, s AS {_ewm_sql('close', 2 / 27, 'bars', 'symbol, date')},
      m AS (SELECT f.symbol, f.date, f.y - s.y AS macd FROM f JOIN s ON f.symbol = s.symbol AND f.date = s.date),
      g AS {_ewm_sql('macd', 2 / 10, 'm', 'symbol, date, macd')}
    SELECT symbol, date, macd, y AS signal, macd - y AS histogram FROM g""",
    "macd signal histogram",
    places=2,
)
def macd_query(spark, d):
    return macd(M.daily_bars(spark, d)).select("symbol", "date", "macd", "signal", "histogram")


@query(
    "p15_atr",
    f"""WITH {B}, x AS (SELECT symbol, date, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {SW}),
      g AS {_ewm_sql('tr', 1 / 14, 'x', 'symbol, date')} SELECT symbol, date, y AS atr FROM g""",
    "atr",
    places=2,
)
def atr_query(spark, d):
    return atr(M.daily_bars(spark, d)).select("symbol", "date", "atr")


@query(
    "p18_manual_override",
    f"""WITH {B}, o AS (SELECT symbol, max(date) AS date, max(close) * 1.01 AS close FROM bars GROUP BY symbol)
    SELECT symbol, date, close, volume FROM bars b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.symbol = b.symbol AND o.date = b.date)
    UNION ALL SELECT symbol, date, close, NULL FROM o""",
    "close volume",
    places=4,
)
def manual_override(spark, d):
    from tidemark.sources.files import override_today

    b = M.daily_bars(spark, d).select("symbol", "date", "close", "volume")
    today = b.groupBy("symbol").agg(F.max("date").alias("date"), (F.max("close") * 1.01).alias("close"))
    return override_today(b, today)


_TRIG = f"""f AS (SELECT symbol, date, close / ({_ma(200)}) - 1 AS ext, close / ({_ma(20, 'close', 'max')}) - 1 AS hi20, close / lag(close, 126) OVER w - 1 AS t126, close / lag(close, 252) OVER w - 1 AS t252 FROM bars {SW})"""


@query(
    "p19_p20_triggers",
    f"""WITH {B}, {_TRIG} SELECT symbol, date, coalesce(ext >= 0.01 AND t126 >= 0.02, false) AS ext200, coalesce(hi20 >= -0.02 AND t126 >= 0.01, false) AS strength,
      coalesce(t252 > 0, false) AS tsmom_pos, coalesce(t252 <= 0, false) AS tsmom_neg FROM f""",
)
def triggers(spark, d):
    from tidemark.plans.research import indicators, trigger_columns

    return trigger_columns(indicators(M.daily_bars(spark, d)), ext=0.01, trail=0.02, hi20=-0.02, strength=0.01).select("symbol", "date", "ext200", "strength", "tsmom_pos", "tsmom_neg")


@query(
    "p23_drop_open_bar",
    f"WITH {IN} SELECT symbol, count(*) AS n, max(bar_ts) AS last_bar FROM intraday WHERE bar_ts + INTERVAL 15 minutes <= TIMESTAMP '2024-01-20 10:07:00' GROUP BY symbol",
)
def drop_open(spark, d):
    from tidemark.plans.intraday import closed_bars

    return closed_bars(M.intraday_bars(spark, d), "2024-01-20 10:07:00").groupBy("symbol").agg(F.count("*").alias("n"), F.max("bar_ts").cast("timestamp_ntz").alias("last_bar"))


@query(
    "p24_snapshot_offsets",
    f"""WITH {B}, f AS (SELECT symbol, date, close, {_ma(200)} AS ma200, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS back FROM bars)
    SELECT symbol, back::INT AS back, date, CASE WHEN ma200 IS NOT NULL THEN close END AS close, ma200 FROM f WHERE back IN (0, 21, 63, 126, 252)""",
    "close ma200",
    places=4,
)
def snapshots(spark, d):
    b = M.daily_bars(spark, d).withColumn("ma200", rolling(F.avg, "close", 200))
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))) - 1
    return b.withColumn("back", back.cast("int")).where(F.col("back").isin(0, 21, 63, 126, 252)).select("symbol", "back", "date", F.when(F.col("ma200").isNotNull(), F.col("close")).alias("close"), "ma200")


@query(
    "p25_p26_sentences",
    """SELECT s_suppkey, s_name || ' ranks ' || r || CASE WHEN r % 100 IN (11, 12, 13) THEN 'th' WHEN r % 10 = 1 THEN 'st' WHEN r % 10 = 2 THEN 'nd' WHEN r % 10 = 3 THEN 'rd' ELSE 'th' END || ' by balance.' AS plain
    FROM (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)""",
)
def sentences(spark, d):
    s = M.table(spark, d, "supplier").withColumn("r", F.row_number().over(W.orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return s.select("s_suppkey", F.concat("s_name", F.lit(" ranks "), S.ordinal(F.col("r")), F.lit(" by balance.")).alias("plain"))


_TAGS = "t(ord, a, b, tag) AS (VALUES (0, DATE '1995-01-01', DATE '1995-12-31', 'calm era'), (1, DATE '1995-06-01', DATE '1997-06-30', 'boom'), (2, DATE '1999-01-01', DATE '1999-12-31', 'late'))"
TAGS = [(0, "1995-01-01", "1995-12-31", "calm era"), (1, "1995-06-01", "1997-06-30", "boom"), (2, "1999-01-01", "1999-12-31", "late")]


@query("p27_j15_tag_lookup", f"WITH {B}, {_TAGS} SELECT symbol, date, coalesce((SELECT arg_min(tag, ord) FROM t WHERE date BETWEEN a AND b), 'unknown') AS tag FROM bars")
def tags(spark, d):
    from tidemark.plans.research import tag_periods

    periods = spark.createDataFrame(TAGS, "ord int, a string, b string, tag string").withColumn("a", F.to_date("a")).withColumn("b", F.to_date("b"))
    return tag_periods(M.daily_bars(spark, d).select("symbol", "date"), periods)


# ---- regimes

_VIXL = "CASE WHEN v < 20 THEN 'calm' WHEN v <= 30 THEN 'elevated' WHEN v > 30 THEN 'stressed' ELSE 'unknown' END"


@query("r01_vix_label", f"WITH {B}, {VX}, j AS (SELECT symbol, date, last_value(vix IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS v FROM bars LEFT JOIN vix USING (date)) SELECT symbol, date, {_VIXL} AS label FROM j")
def vix_labels(spark, d):
    j = alignment.reindex_ffill(M.daily_bars(spark, d), M.vix(spark, d), "vix")
    return j.select("symbol", "date", regimes.vix_label(F.col("vix")).alias("label"))


LOOK = regimes.CREDIT_LOOKBACK
_CREDIT = f"""ch AS (SELECT date, credit, credit - lag(credit, 63) OVER (ORDER BY date) AS change FROM credit),
  va AS (SELECT date, list(change) OVER (ORDER BY date ROWS {LOOK - 1} PRECEDING) AS l FROM ch WHERE change IS NOT NULL),
  pc AS (SELECT date, CASE WHEN len(l) >= {LOOK} THEN len(list_filter(l, lambda x: x < l[-1])) * 100.0 / {LOOK} END AS pct FROM va),
  cl AS (SELECT ch.date, change, pct, CASE WHEN pct >= 80 THEN 'widening' WHEN pct <= 20 THEN 'narrowing' WHEN pct IS NOT NULL THEN 'flat' ELSE 'unknown' END AS credit_label FROM ch LEFT JOIN pc USING (date))"""


@query("r02_w21_credit_percentile", f"WITH {CR}, {_CREDIT} SELECT date, change, pct, credit_label FROM cl", "change pct")
def credit_labels(spark, d):
    return regimes.credit_label_percentile(M.credit(spark, d), LOOK).select("date", "change", "pct", "credit_label")


@query(
    "r03_r05_change_labels",
    f"""WITH {CR}, c AS (SELECT date, credit - lag(credit, 63) OVER (ORDER BY date) AS x FROM credit)
    SELECT date, CASE WHEN x > 0.25 THEN 'widening' WHEN x < -0.25 THEN 'narrowing' WHEN x IS NOT NULL THEN 'flat' ELSE 'unknown' END AS credit_abs,
      CASE WHEN x > 0.1 THEN 'rising' WHEN x < -0.1 THEN 'falling' WHEN x IS NOT NULL THEN 'flat' ELSE 'unknown' END AS rates FROM c""",
)
def change_labels(spark, d):
    w = W.partitionBy(F.lit(1)).orderBy("date")
    return M.credit(spark, d).select("date", regimes.change_label("credit", 63, 0.25, "widening", "narrowing", w).alias("credit_abs"), regimes.change_label("credit", 63, 0.1, "rising", "falling", w).alias("rates"))


_TREND = """bt AS (SELECT date, CASE WHEN count(bench) OVER q < 200 THEN 'unknown' WHEN bench >= avg(bench) OVER q THEN 'above' ELSE 'below' END AS trend FROM bench WINDOW q AS (ORDER BY date ROWS 199 PRECEDING))"""


@query(
    "r04_trend_labels",
    f"""WITH {B}, {BE}, {_TREND}, j AS (SELECT symbol, date, last_value(bench IGNORE NULLS) OVER w AS bench, last_value(trend IGNORE NULLS) OVER w AS trend FROM bars LEFT JOIN bench USING (date) LEFT JOIN bt USING (date) {SW})
    SELECT symbol, date, coalesce(trend, 'unknown') AS own_calendar, CASE WHEN count(bench) OVER q < 200 THEN 'unknown' WHEN bench >= avg(bench) OVER q THEN 'above' ELSE 'below' END AS aligned
    FROM j WINDOW q AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)""",
)
def trends(spark, d):
    bench = M.benchmark(spark, d)
    j = alignment.reindex_ffill(M.daily_bars(spark, d), bench, "bench").withColumn("ma", rolling(F.avg, "bench", 200))
    j = alignment.reindex_ffill(j, regimes.trend_own_calendar(bench), "trend")
    return j.select("symbol", "date", F.coalesce("trend", F.lit("unknown")).alias("own_calendar"), regimes.trend_label(F.col("bench"), F.col("ma")).alias("aligned"))


REGIMES_SQL = f"""{B}, {BE}, {VX}, {CR}, {_CREDIT}, {_TREND},
  rg0 AS (SELECT b.*, last_value(vix IGNORE NULLS) OVER w AS v, last_value(credit_label IGNORE NULLS) OVER w AS cl, last_value(trend IGNORE NULLS) OVER w AS tr
    FROM bars b LEFT JOIN vix USING (date) LEFT JOIN cl USING (date) LEFT JOIN bt USING (date) {SW}),
  rg AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, {_VIXL} AS vix_label, coalesce(cl, 'unknown') AS credit_label, coalesce(tr, 'unknown') AS trend FROM rg0)"""


def regime_bars(spark, d):
    b = regimes.with_regimes(M.daily_bars(spark, d), M.vix(spark, d), M.credit(spark, d), M.benchmark(spark, d), LOOK)
    return b.withColumn("pos", position())


def inputs(spark, d):
    """The daily series and the labelled bars, each written once: what the forecast plans read."""
    m = M.stored_market(spark, d)
    return m, stored(regimes.with_regimes(m.bars, m.vix, m.credit, m.bench, LOOK).withColumn("pos", position()), "regimes")


@query(
    "r06_r07_regime_tuple",
    f"WITH {REGIMES_SQL} SELECT symbol, date, vix_label || '/' || credit_label || '/' || trend AS regime, vix_label = 'stressed' AND trend = 'below' AND credit_label = 'widening' AS regime_break FROM rg",
)
def regime_tuple(spark, d):
    broke = (F.col("vix_label") == "stressed") & (F.col("trend") == "below") & (F.col("credit_label") == "widening")
    return regime_bars(spark, d).select("symbol", "date", F.concat_ws("/", "vix_label", "credit_label", "trend").alias("regime"), broke.alias("regime_break"))


GROUPS = [(f"g{i}", i, f"Brand#{a}{b}") for i, a in enumerate((1, 2, 3, 4, 5)) for b in (1, 2, 3, 4, 5)]
_GROUPS = "gr(grp, ord, symbol) AS (VALUES " + ", ".join(str(g) for g in GROUPS) + ")"
LEADER_SQL = f"""{P}, {BE}, {_GROUPS},
  pr AS (SELECT symbol, date, close / lag(close, 63) OVER w - 1 AS ret FROM panel {SW}),
  br AS (SELECT date, bench / lag(bench, 63) OVER (ORDER BY date) - 1 AS base FROM bench),
  gs AS (SELECT date, grp, ord, (avg(ret) - any_value(base)) * 100 AS spread FROM pr JOIN gr USING (symbol) JOIN br USING (date) WHERE ret IS NOT NULL GROUP BY date, grp, ord),
  gb AS (SELECT * FROM gs WHERE spread IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY abs(spread) DESC, ord) = 1),
  lead_ AS (SELECT date, CASE WHEN grp IS NULL THEN 'unknown' WHEN spread >= 2 THEN grp || '-led' WHEN spread <= -2 THEN 'anti-' || grp ELSE 'broad' END AS leader, spread FROM bench LEFT JOIN gb USING (date))"""


LEADER_RUNS_SQL = f"{LEADER_SQL}, ln_ AS (SELECT *, CASE WHEN leader IS NOT DISTINCT FROM lag(leader) OVER (ORDER BY date) AND row_number() OVER (ORDER BY date) > 1 THEN 0 ELSE 1 END AS new FROM lead_), lr AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM ln_)"
CONTEXT_SQL = "cx AS (SELECT date, spread, CASE WHEN leader = 'unknown' THEN 0 ELSE (date - min(date) OVER (PARTITION BY run ORDER BY date) + 1) / 7.0 END::DOUBLE AS age_weeks FROM lr)"


def leaders(spark, d):
    groups = spark.createDataFrame(GROUPS, "grp string, ord int, symbol string")
    return regimes.leadership(M.panel_bars(spark, d), groups, M.benchmark(spark, d))


def rotation(spark, d):
    """The rotation context of every date, written once."""
    return stored(studies.rotation_context(leaders(spark, d)), "context")


@query("r08_leadership", f"WITH {LEADER_SQL} SELECT date, leader, spread FROM lead_", "spread", places=4)
def leadership(spark, d):
    return leaders(spark, d)


# ---- joins

@query("j01_inner_dates", f"WITH {BE}, {VX} SELECT date, bench, vix FROM bench JOIN vix USING (date)", "bench vix", places=4)
def inner_dates(spark, d):
    return M.benchmark(spark, d).join(M.vix(spark, d), "date").dropna()


@query("j02_reindex_ffill", f"WITH {B}, {VX} SELECT symbol, date, last_value(vix IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS vix FROM bars LEFT JOIN vix USING (date)", "vix")
def ffill(spark, d):
    return alignment.reindex_ffill(M.daily_bars(spark, d).select("symbol", "date"), M.vix(spark, d), "vix")


@query("j03_asof_backward", f"WITH {P}, {VX} SELECT p.symbol, p.date, vix FROM panel p ASOF LEFT JOIN vix v ON p.date >= v.date", "vix")
def asof(spark, d):
    return alignment.asof_backward(M.panel_bars(spark, d).select("symbol", "date"), M.vix(spark, d), "vix")


@query("j04_first_on_or_after", f"WITH {B}, o AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), s AS (SELECT DISTINCT symbol FROM bars), q AS (SELECT symbol, date FROM o, s), n AS (SELECT symbol, date, date AS trade_date FROM bars) SELECT q.symbol, q.date, trade_date FROM q ASOF LEFT JOIN n ON q.symbol = n.symbol AND q.date <= n.date")
def on_or_after(spark, d):
    b = M.daily_bars(spark, d).select("symbol", "date")
    dates = M.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    ask = dates.crossJoin(F.broadcast(b.select("symbol").distinct()))  # days x six symbols
    return alignment.first_on_or_after(ask, b.withColumn("trade_date", F.col("date")), "trade_date", by=["symbol"])


@query("j12_w30_forward_windows", f"WITH {B} SELECT symbol, date, lead(close, 21) OVER w / close - 1 AS fwd21, CASE WHEN lead(close, 21) OVER w IS NOT NULL THEN min(close) OVER f / close - 1 END AS mae21, CASE WHEN lead(close, 21) OVER w IS NOT NULL THEN max(close) OVER f / close - 1 END AS mfe21 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 21 FOLLOWING)", "fwd21 mae21 mfe21")
def forward(spark, d):
    from tidemark.plans.outcomes import forward_stats

    return forward_stats(M.daily_bars(spark, d), [21]).select("symbol", "date", F.col("ret").alias("fwd21"), F.col("mae").alias("mae21"), F.col("mfe").alias("mfe21"))


@query(
    "j13_knn_embeddings",
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT q.vec_id, e.vec_id AS other, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist FROM q JOIN embeddings e ON e.vec_id < q.vec_id)
    SELECT vec_id, other, dist, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS rk FROM e) WHERE rk <= 3""",
    "dist",
)
def knn(spark, d):
    from tidemark.plans.analogs import nearest_vectors

    e = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("x"))
    near = nearest_vectors(e, e.where("pos % 20 = 0"), 3)
    return near.select(F.col("query_pos").alias("vec_id"), F.col("pos").alias("other"), "dist", F.col("rk").cast("int").alias("rk"))


@query("j17_cross_product", f"WITH {B} SELECT symbol, h FROM (SELECT DISTINCT symbol FROM bars), (VALUES (1), (5), (20), (60)) t(h)")
def grid(spark, d):
    h = spark.createDataFrame([(1,), (5,), (20,), (60,)], "h int")
    return M.daily_bars(spark, d).select("symbol").distinct().crossJoin(F.broadcast(h))


# ---- window and sequence operators

@query(
    "w04_w05_expanding_lows",
    f"""WITH {B}, x AS (SELECT *, min(close) OVER w AS run_min, row_number() OVER w AS rn, close <= min(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS low20 FROM bars {SW})
    SELECT symbol, date, run_min, (rn - max(CASE WHEN close <= run_min THEN rn END) OVER w)::BIGINT AS since_low, low20 FROM x {SW}""",
    "run_min",
    places=4,
)
def lows(spark, d):
    w = series().rowsBetween(W.unboundedPreceding, 0)
    b = M.daily_bars(spark, d).withColumn("run_min", F.min("close").over(w)).withColumn("rn", F.row_number().over(series()))
    since = F.col("rn") - F.max(F.when(F.col("close") <= F.col("run_min"), F.col("rn"))).over(w)
    return b.select("symbol", "date", "run_min", since.cast("long").alias("since_low"), (F.col("close") <= F.min("close").over(trailing(20))).alias("low20"))


@query(
    "w06_streak_above_ma20",
    f"""WITH {B}, x AS (SELECT symbol, date, coalesce(close >= ({_ma(20)}), false) AS up, row_number() OVER w AS rn FROM bars {SW})
    SELECT symbol, date, (rn - coalesce(max(CASE WHEN NOT up THEN rn END) OVER w, 0))::BIGINT AS streak FROM x {SW}""",
)
def streaks(spark, d):
    b = M.daily_bars(spark, d).withColumn("ma20", rolling(F.avg, "close", 20))
    return with_streak(b, F.col("close") >= F.col("ma20"), "streak").select("symbol", "date", "streak")


@query(
    "w07_swing_lows",
    f"""WITH {B}, x AS (SELECT symbol, date, low, min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars),
      y AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM x WHERE low = m AND back BETWEEN 6 AND 55)
    SELECT symbol, date, low, rk::INT AS rk FROM y WHERE rk <= 2""",
    "low",
    places=4,
)
def swings(spark, d):
    from tidemark.plans.technicals import swing_lows

    return swing_lows(M.daily_bars(spark, d))


@query("w08_ewm", f"WITH {B}, g AS {_ewm_sql('close', 2 / 21, 'bars', 'symbol, date')} SELECT symbol, date, y AS ema20 FROM g", "ema20", places=2)
def ewm_query(spark, d):
    return ewm(M.daily_bars(spark, d), "close", 2 / 21, "ema20").select("symbol", "date", "ema20")


def thin_sql(cand: str, gap: int, by: str, name: str = "kept") -> str:
    """Recursive CTE of greedy thinning over relation cand (by, pos)."""
    return f"{name} AS (SELECT {by}, min(pos) AS pos FROM {cand} GROUP BY {by} UNION ALL SELECT {by}, min(c.pos) FROM {name} k JOIN {cand} c USING ({by}) WHERE c.pos >= k.pos + {gap} GROUP BY {by}, k.pos)"


def nearest_first_sql(near: str, keys: str, gap: int, most: int, name: str) -> str:
    """Recursive CTE over relation near (keys, pos, rk from 1): kept (keys, kept), the nearest first, gap rows apart, at most `most`."""
    on = " AND ".join(f"n.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""{name}_steps AS (SELECT DISTINCT {keys}, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM {near}
    UNION ALL SELECT {own}, n.rk, CASE WHEN len(t.kept) < {most} AND len(list_filter(t.kept, lambda k: abs(k - n.pos) < {gap})) = 0 THEN list_append(t.kept, n.pos) ELSE t.kept END
      FROM {name}_steps t JOIN {near} n ON {on} AND n.rk = t.rk + 1),
  {name} AS (SELECT {keys}, arg_max(kept, rk) AS kept FROM {name}_steps GROUP BY {keys})"""


_HITS = f"hit AS (SELECT symbol, pos FROM (SELECT symbol, row_number() OVER w - 1 AS pos, close / ({_ma(252, 'close', 'max', 60)}) - 1 AS dd FROM bars {SW}) WHERE dd <= -0.1)"


@query("w09_greedy_thinning", f"WITH RECURSIVE {B}, {_HITS}, {thin_sql('hit', 21, 'symbol')} SELECT symbol, pos FROM kept")
def greedy(spark, d):
    b = M.daily_bars(spark, d).withColumn("pos", position()).withColumn("hi", rolling(F.max, "close", 252, 60))
    return thinning.greedy_thin(b.where("close / hi - 1 <= -0.1"), 21, ["symbol"])


@query(
    "w10_distance_thinning",
    f"""WITH RECURSIVE pairs AS (SELECT q.vec_id AS query_pos, e.vec_id AS pos, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist FROM embeddings q JOIN embeddings e ON e.vec_id < q.vec_id WHERE q.vec_id % 20 = 0),
      near AS (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY dist, pos) AS rk FROM pairs QUALIFY rk <= 120), {nearest_first_sql('near', 'query_pos', 20, 60, 'thinned')}
    SELECT query_pos, unnest(kept) AS pos, generate_subscripts(kept, 1)::INT AS nth FROM thinned""",
)
def distance_thin(spark, d):
    from tidemark.plans.analogs import nearest_vectors, thin_nearest

    e = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("x"))
    kept = thin_nearest(nearest_vectors(e, e.where("pos % 20 = 0"), 120), 20, 60, by=["query_pos"])
    return kept.select("query_pos", F.posexplode("kept").alias("nth", "pos")).select("query_pos", "pos", (F.col("nth") + 1).alias("nth"))


@query(
    "w12_crossings",
    f"""WITH {B}, x AS (SELECT symbol, date, coalesce(close >= ({_ma(50)}), false) AS up FROM bars), y AS (SELECT *, lag(up) OVER w AS before FROM x {SW})
    SELECT symbol, date FROM y WHERE up AND NOT before""",
)
def crossings(spark, d):
    from tidemark.plans.research import crossed

    b = M.daily_bars(spark, d).withColumn("ma", rolling(F.avg, "close", 50)).withColumn("up", F.coalesce(F.col("close") >= F.col("ma"), F.lit(False)))
    return crossed(b, "up").select("symbol", "date")


@query(
    "w13_first_hit_per_uptrend",
    f"""WITH {B}, x AS (SELECT symbol, date, row_number() OVER w AS rn, coalesce(close >= ({_ma(200)}), false) AS up, close >= ({_ma(20, 'close', 'max')}) AS hit FROM bars {SW}),
      y AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER w AS stretch FROM x {SW})
    SELECT symbol, min(date) AS date FROM y WHERE up AND hit GROUP BY symbol, stretch""",
)
def first_hits(spark, d):
    from tidemark.plans.research import first_per_uptrend

    b = M.daily_bars(spark, d).withColumn("ma200", rolling(F.avg, "close", 200)).withColumn("hi20", rolling(F.max, "close", 20))
    return first_per_uptrend(b, F.col("close") >= F.col("hi20")).select("symbol", "date")


RUNS_SQL = f"""{VX}, vl AS (SELECT '*' AS symbol, date, CASE WHEN vix < 20 THEN 'calm' WHEN vix <= 30 THEN 'elevated' ELSE 'stressed' END AS label FROM vix),
  vn AS (SELECT *, CASE WHEN label = lag(label) OVER (ORDER BY date) THEN 0 ELSE 1 END AS new FROM vl),
  vr AS (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM vn)"""


def vix_runs(spark, d):
    v = M.vix(spark, d).select(F.lit("*").alias("symbol"), "date", regimes.vix_label(F.col("vix")).alias("label"))
    return with_runs(v, "label")


@query("w14_w15_runs_and_onsets", f"WITH {RUNS_SQL} SELECT label, min(date) AS start, max(date) AS stop, count(*) AS rows, count(*) >= 10 AS onset FROM vr GROUP BY run, label")
def runs(spark, d):
    return vix_runs(spark, d).groupBy("run", "label").agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.count("*").alias("rows"), (F.count("*") >= 10).alias("onset")).drop("run")


@query("w16_run_age", f"WITH {RUNS_SQL} SELECT date, label, (date - min(date) OVER (PARTITION BY run ORDER BY date) + 1)::INT AS age_days FROM vr")
def run_age(spark, d):
    age = F.datediff("date", F.min("date").over(W.partitionBy("run").orderBy("date"))) + 1
    return vix_runs(spark, d).select("date", "label", age.alias("age_days"))


@query(
    "a18_run_durations",
    f"""WITH {RUNS_SQL}, x AS (SELECT label, run, max(date) - min(date) + 1 AS days FROM vr GROUP BY label, run)
    SELECT label, count(*) AS n, max(days)::INT AS longest, quantile_cont(days, 0.5)::DOUBLE AS median_days, quantile_cont(days, 0.5)::DOUBLE / 7 AS median_weeks FROM x GROUP BY label""",
    "median_days median_weeks",
)
def run_durations(spark, d):
    x = vix_runs(spark, d).groupBy("label", "run").agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.max("days").alias("longest"), F.percentile("days", 0.5).alias("median_days"), (F.percentile("days", 0.5) / 7).alias("median_weeks"))


@query(
    "w17_percent_rank",
    f"""WITH {P}, r AS (SELECT symbol, date, close / lag(close, 21) OVER w - 1 AS ret FROM panel {SW})
    SELECT symbol, date, CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(ret) OVER (PARTITION BY date, ret) - 1) / 2.0) / count(ret) OVER (PARTITION BY date) END AS pr FROM r""",
    "pr",
)
def pct_rank(spark, d):
    r = M.panel_bars(spark, d).withColumn("ret", n_bar_return("close", 21))
    return r.select("symbol", "date", percent_rank_average("ret", "date").alias("pr"))


@query("w22_session_vwap", f"WITH {IN} SELECT symbol, bar_ts, sum((high + low + close) / 3 * volume) OVER s / sum(volume) OVER s AS vwap FROM intraday WINDOW s AS (PARTITION BY symbol, session ORDER BY bar_ts)", "vwap", places=4)
def session_vwap(spark, d):
    from tidemark.plans.intraday import vwap_by_session

    return vwap_by_session(M.intraday_bars(spark, d)).select("symbol", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), "vwap")


@query("w23_running_vwap", f"WITH {IN} SELECT symbol, bar_ts, sum(close * volume) OVER s / nullif(sum(volume) OVER s, 0) AS vwap FROM intraday WINDOW s AS (PARTITION BY symbol ORDER BY bar_ts)", "vwap", places=4)
def running_vwap(spark, d):
    from tidemark.plans.intraday import vwap_running

    return vwap_running(M.intraday_bars(spark, d)).select("symbol", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), "vwap")


@query("w24_support_resistance", f"WITH {B} SELECT symbol, date, {_ma(20, 'high', 'max')} AS res20, {_ma(20, 'low', 'min')} AS sup20, {_ma(100, 'high', 'max')} AS res100, {_ma(100, 'low', 'min')} AS sup100 FROM bars", "res20 sup20 res100 sup100", places=4)
def support(spark, d):
    return M.daily_bars(spark, d).select("symbol", "date", rolling(F.max, "high", 20).alias("res20"), rolling(F.min, "low", 20).alias("sup20"), rolling(F.max, "high", 100).alias("res100"), rolling(F.min, "low", 100).alias("sup100"))


@query(
    "w25_cross_states",
    f"""WITH {B}, x AS (SELECT symbol, date, ({_ma(50)}) - ({_ma(200)}) AS diff FROM bars), y AS (SELECT *, lag(diff) OVER w AS before FROM x {SW})
    SELECT symbol, date, CASE WHEN before <= 0 AND diff > 0 THEN 'bullish' WHEN before >= 0 AND diff < 0 THEN 'bearish' ELSE 'none' END AS state FROM y""",
)
def cross_states(spark, d):
    from tidemark.plans.technicals import cross_state

    b = M.daily_bars(spark, d).withColumn("diff", rolling(F.avg, "close", 50) - rolling(F.avg, "close", 200))
    return b.select("symbol", "date", cross_state("diff").alias("state"))


@query(
    "w28_w29_forward_paths",
    f"""WITH {B}, x AS (SELECT symbol, date, close, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 126 FOLLOWING) AS l FROM bars)
    SELECT symbol, date, len(l)::INT AS n, l[6] / l[1] * 100 AS at5, list_min(l) / l[1] - 1 AS worst, (list_position(l, list_min(l)) - 1)::INT AS days_to_trough, len(list_filter(l, lambda v, i: (i - 1) % 5 = 0))::INT AS samples FROM x WHERE len(l) >= 6""",
    "at5 worst",
    places=4,
)
def paths(spark, d):
    from tidemark.plans.outcomes import forward_paths

    p = forward_paths(M.daily_bars(spark, d), 126, 5)
    return p.where("n >= 6").select("symbol", "date", "n", F.element_at("path", 2).alias("at5"), "worst", "days_to_trough", F.size("path").alias("samples"))


@query(
    "w33_w34_divergence_slope",
    f"""WITH {B}, x AS (SELECT symbol, date, close, {_ma(200)} AS ma200 FROM bars) SELECT symbol, date, coalesce(close > lag(close, 39) OVER w, false) AS higher, coalesce(ma200 - lag(ma200, 20) OVER w < 0, false) AS falling FROM x {SW}""",
)
def slope(spark, d):
    w = series()
    b = M.daily_bars(spark, d).withColumn("ma200", rolling(F.avg, "close", 200))
    return b.select("symbol", "date", F.coalesce(F.col("close") > F.lag("close", 39).over(w), F.lit(False)).alias("higher"), F.coalesce(F.col("ma200") - F.lag("ma200", 20).over(w) < 0, F.lit(False)).alias("falling"))
