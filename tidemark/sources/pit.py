"""Point-in-time store: Parquet by table, key and year; two dates per row, and as-of reads."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PITStoreError(ValueError):
    """A key that was never ingested, or has nothing as of a date."""


class DataContext(Protocol):
    """What engines read: filtered DataFrames, never later than the context's date."""

    def close(self, symbol: str) -> DataFrame: ...
    def ohlcv(self, symbol: str) -> DataFrame: ...
    def macro(self, series: str) -> DataFrame: ...


def as_of(rows: DataFrame, date: str) -> DataFrame:
    """Rows published on or before the date (by processed_date, never by year folder)."""
    return rows.where(F.col("processed_date") <= F.lit(date).cast("date"))


def assert_no_lookahead(rows: DataFrame, date: str, column: str = "date") -> DataFrame:
    """rows, failing in the plan on any later date."""
    return rows.withColumn(column, F.when(F.assert_true(F.col(column) <= F.lit(date).cast("date"), F.lit("lookahead")).isNull(), F.col(column)))


def write_prices(rows: DataFrame, root: str) -> None:
    """rows (symbol, date, open, high, low, close, volume) to root/prices by symbol and year; years that occur are replaced."""
    _write(rows.withColumnRenamed("date", "effective_date").withColumn("processed_date", F.col("effective_date")), f"{root}/prices", "symbol")


def write_macro(rows: DataFrame, root: str) -> None:
    """rows (series, effective_date, value[, processed_date]) to root/macro."""
    if "processed_date" not in rows.columns:
        rows = rows.withColumn("processed_date", F.col("effective_date"))
    _write(rows, f"{root}/macro", "series")


def _write(rows: DataFrame, path: str, key: str) -> None:
    if rows.isEmpty():
        raise ValueError("nothing to write")
    dated = rows.withColumn("year", F.year("effective_date")).repartition(key, "year")
    dated.write.option("partitionOverwriteMode", "dynamic").partitionBy(key, "year").mode("overwrite").parquet(path)


class PointInTimeContext:
    """As-of reads of a store."""

    def __init__(self, spark: SparkSession, root: str, as_of_date: str):
        self.spark, self.root, self.as_of_date = spark, root, as_of_date

    def _read(self, table: str, key: str, value: str) -> DataFrame:
        try:
            everything = self.spark.read.parquet(f"{self.root}/{table}")
        except Exception as e:  # the folder is missing
            raise PITStoreError(f"{table} was never ingested") from e
        rows = everything.where(F.col(key) == value)
        known = as_of(rows, self.as_of_date)
        if known.isEmpty():
            if rows.isEmpty():
                raise PITStoreError(f"{table}/{value} was never ingested")
            raise PITStoreError(f"{table}/{value} has no rows as of {self.as_of_date}")
        return known

    def ohlcv(self, symbol: str) -> DataFrame:
        return self._read("prices", "symbol", symbol).withColumnRenamed("effective_date", "date")

    def close(self, symbol: str) -> DataFrame:
        return self.ohlcv(symbol).select("date", "close")

    def macro(self, series: str) -> DataFrame:
        return self._read("macro", "series", series).select(F.col("effective_date").alias("date"), "value")
