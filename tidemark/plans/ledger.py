"""The append-only forecast ledger over Parquet: inserts, queries, staged writes, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources.files import latest_wins

REQUIRED = {
    "forecasts": ["forecast_id", "ticker", "trading_date", "horizon", "voter"],
    "outcomes": ["forecast_id", "ret"],
    "decisions": ["decision_id", "forecast_id", "action"],
    "episodes": ["asset", "event_date"],
}
DEAD_AFTER = 5


class Ledger:
    """Tables under one folder; rows are appended, never changed, except that the latest episode of a key counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Appends rows; any row without a required field fails the whole append."""
        bad = rows.where(F.size(S.missing_fields({c: F.col(c) for c in REQUIRED[name]})) > 0)
        if not bad.isEmpty():
            raise ValueError(f"{name}: rows lack required fields")
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def append_new(self, name: str, rows: DataFrame, key: str) -> None:
        """Appends the rows whose key isn't there yet: a repeated run adds nothing."""
        try:
            rows = rows.join(self.table(name).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        self.append(name, rows)

    def episodes(self) -> DataFrame:
        return latest_wins(self.table("episodes"), ["asset", "event_date"], "written_at")


def pending_outcomes(forecasts: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Forecasts without an outcome whose horizon has passed in calendar days (a lower bound), oldest first."""
    ripe = forecasts.where(F.date_add("trading_date", F.col("horizon")) <= F.lit(now).cast("date"))
    return ripe.join(outcomes.select("forecast_id"), "forecast_id", "left_anti")


def unactioned(forecasts: DataFrame, decisions: DataFrame, excluded_voter: str = "dip_context") -> DataFrame:
    return forecasts.where(F.col("voter") != excluded_voter).join(decisions.select("forecast_id"), "forecast_id", "left_anti")


def calibration_rows(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    return forecasts.join(outcomes, "forecast_id")


def calibration(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """ticker, horizon, label -> n, hit_rate, stated, brier."""
    j = calibration_rows(forecasts, outcomes)
    hit = F.col("ret") > 0
    return j.groupBy("ticker", "horizon", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("p_positive").alias("stated"), F.avg(S.brier(F.col("p_positive"), hit)).alias("brier")
    )


def calibration_buckets(forecasts: DataFrame, outcomes: DataFrame, buckets: int = 5) -> DataFrame:
    """bucket -> n, hit_rate: confidence cut into equal buckets over 0..100; 100 itself is one past the last."""
    j = calibration_rows(forecasts, outcomes).withColumn("bucket", F.expr(f"width_bucket(confidence, 0, 100, {buckets})").cast("int"))
    return j.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))


def block_counts(forecasts: DataFrame, horizons=(1, 5, 20, 60, 21, 63)) -> DataFrame:
    return forecasts.where(F.col("horizon").isin(*horizons)).groupBy("voter", "horizon").agg(F.count(F.lit(1)).alias("n"))


def block_count_map(forecasts: DataFrame) -> DataFrame:
    entry = F.struct(F.concat_ws("_", "voter", F.col("horizon").cast("string")).alias("k"), F.col("n").alias("v"))
    return block_counts(forecasts).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("counts"))


def latest_batch(forecasts: DataFrame) -> DataFrame:
    """Every row of each ticker's latest batch."""
    return forecasts.withColumn("__r", F.rank().over(W.partitionBy("ticker").orderBy(F.desc("as_of_ts")))).where("__r = 1").drop("__r")


def advance_staged(staged: DataFrame, results: DataFrame) -> DataFrame:
    """One flush of staged writes (write_id, attempts, ...): with results (write_id, ok), state becomes persisted, staged
    (one attempt more) or, from the fifth failure on, dead_letter. A write without a result failed."""
    j = staged.join(results, "write_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    j = j.withColumn("attempts", F.when(F.col("ok"), F.col("attempts")).otherwise(F.col("attempts") + 1))
    state = F.when(F.col("ok"), "persisted").when(F.col("attempts") >= DEAD_AFTER, "dead_letter").otherwise("staged")
    return j.withColumn("state", state)


def after_resume_point(rows: DataFrame, done: DataFrame, keys: list[str], order: str = "trading_date") -> DataFrame:
    """Rows strictly after the last one done of their key."""
    last = done.groupBy(*keys).agg(F.max(order).alias("__last"))
    return rows.join(last, keys, "left").where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__last")


def nested_decisions(decisions: DataFrame, forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """decisions with their forecast and its outcomes as nested values."""
    per = outcomes.groupBy("forecast_id").agg(F.sort_array(F.collect_list(F.struct("evaluated_at", "ret"))).alias("outcomes"))
    f = forecasts.join(per, "forecast_id", "left").select("forecast_id", F.struct("ticker", "horizon", "p_positive", "outcomes").alias("forecast"))
    return decisions.join(f, "forecast_id", "left")


def thin_payload(evidence: Column, path: str) -> Column:
    return F.get_json_object(evidence, path)
