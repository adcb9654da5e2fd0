"""Streaming forms against their batch plans."""

from pyspark.sql import functions as F

from tidemark.plans.intraday import vwap_by_session
from tidemark.sources import market
from tidemark.streaming import bars as SB

SF = "/root/testdata/sf0.001"


def run(query, name):
    q = query.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def stream(spark, folder, table="events.parquet"):
    schema = spark.read.parquet(f"{SF}/{table}").schema
    return spark.readStream.schema(schema).parquet(str(folder))


def test_closed_bars_equal_batch_bars(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(SB.closed_bars(stream(spark, tmp_path / "in")), "closed")
    got = {(r.symbol, r.bar_ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("closed").collect()}
    want = {(r.symbol, r.bar_ts): (r.open, r.high, r.low, r.close, r.volume) for r in market.intraday_bars(spark, SF).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = max(k[1] for k in want)
    assert max(k[1] for k in got) < last  # the open bar is held back


def test_session_vwap_keeps_state_over_batches(spark, tmp_path):
    bars = market.intraday_bars(spark, SF).drop("session")
    cut = bars.select(F.expr("percentile(unix_timestamp(bar_ts), 0.5)")).first()[0]
    folder = tmp_path / "bars"
    early = F.unix_timestamp("bar_ts") <= F.lit(cut)
    bars.where(early).coalesce(1).write.parquet(str(folder))
    src = spark.readStream.schema(bars.schema).parquet(str(folder))
    q = SB.session_vwap(src).writeStream.outputMode("append").format("memory").queryName("vw").start()
    try:
        q.processAllAvailable()
        bars.where(~early).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.symbol, r.bar_ts): round(r.vwap, 6) for r in spark.table("vw").collect()}
    want = {(r.symbol, r.bar_ts): round(r.vwap, 6) for r in vwap_by_session(market.intraday_bars(spark, SF)).collect()}
    assert got == want


def test_staged_flush_is_idempotent(spark, tmp_path):
    staged, dead, src = (str(tmp_path / x) for x in ("staged", "dead", "src"))
    spark.createDataFrame([("w1", 4), ("w2", 0), ("w3", 1)], "write_id string, attempts int").write.parquet(f"{staged}/batch=0")
    spark.createDataFrame([("w2", True)], "write_id string, ok boolean").write.parquet(src)
    results = spark.readStream.schema("write_id string, ok boolean").parquet(src)
    q = SB.flush_staged(results, staged, dead).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.write_id, r.attempts) for r in spark.read.parquet(f"{staged}/batch=1").collect()] == [("w3", 2)]
    assert [r.write_id for r in spark.read.parquet(f"{dead}/batch=0").collect()] == ["w1"]
