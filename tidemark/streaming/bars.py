"""Structured Streaming forms of the intraday operators and of the staged-write queue.

The batch plans have no unbounded inputs; these are the same semantics over a stream:
a bar is emitted when the watermark has passed its end, so open bars never appear.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ledger import advance_staged

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def closed_bars(events: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """events (ts, event_id, event_type, value) -> symbol, bar_ts, open, high, low, close, volume; append mode emits closed bars only."""
    order = F.struct("ts", "event_id")
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), F.col("event_type").alias("symbol"))
    bars = g.agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def session_windows(events: DataFrame, gap: str = "20 minutes", late: str = "30 minutes") -> DataFrame:
    """symbol, start, stop, n: activity sessions that end after a gap."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col("event_type").alias("symbol"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def session_vwap(bars: DataFrame) -> DataFrame:
    """bars (symbol, bar_ts, high, low, close, volume) in order -> symbol, bar_ts, vwap: cumulative per symbol and day, as state."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pv, v = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("bar_ts")
        typical = (rows["high"] + rows["low"] + rows["close"]) / 3
        num, den = pv + (typical * rows["volume"]).cumsum(), v + rows["volume"].cumsum()
        state.update((float(num.iloc[-1]), float(den.iloc[-1])))
        yield pd.DataFrame({"symbol": rows["symbol"], "bar_ts": rows["bar_ts"], "vwap": num / den.where(den != 0)})

    keyed = bars.withColumn("session", F.to_date("bar_ts"))
    return keyed.groupBy("symbol", "session").applyInPandasWithState(
        step, "symbol string, bar_ts timestamp, vwap double", "pv double, v double", "append", "NoTimeout"
    )


def flush_staged(results: DataFrame, staged_path: str, dead_path: str):
    """A foreachBatch function: results (write_id, ok) move staged writes on. A batch that runs again finds its
    output in place and does nothing, so each batch counts once."""

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{staged_path}/batch={number + 1}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return
        staged = spark.read.parquet(f"{staged_path}/batch={number}")
        moved = advance_staged(staged, batch.groupBy("write_id").agg(F.max("ok").alias("ok"))).drop("ok")
        moved.where("state = 'dead_letter'").drop("state").write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        moved.where("state = 'staged'").drop("state").write.mode("overwrite").parquet(f"{staged_path}/batch={number + 1}")

    return results.writeStream.foreachBatch(on_batch)
