"""Purged walk-forward folds, and a Gaussian HMM of market states with its diagnostic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import n_bar_return, rolling


def purged_folds(spark: SparkSession, n: int, splits: int, horizon: int = 0, embargo: int = 0, min_train: int = 1) -> DataFrame:
    """fold, test_start, test_end, train_end, hole_start, hole_end (half-open): a fold trains on [0, train_end) less the hole.

    Labels that reach into the test fold are purged; the rows after the fold before it are embargoed; the last fold
    takes the rest; folds with too few training rows are left out.
    """
    if splits < 1 or n // (splits + 1) < 1:
        raise ValueError("too few rows for the splits")
    size = n // (splits + 1)
    f = spark.range(1, splits + 1).select(F.col("id").alias("fold"))
    f = f.withColumn("test_start", F.col("fold") * size).withColumn("test_end", F.when(F.col("fold") == splits, n).otherwise((F.col("fold") + 1) * size).cast("long"))
    f = f.withColumn("train_end", F.greatest(F.lit(0), F.col("test_start") - horizon).cast("long"))
    first = F.col("fold") == 1
    f = f.withColumn("hole_start", F.when(first, F.col("train_end")).otherwise(F.least("test_start", "train_end")).cast("long"))
    f = f.withColumn("hole_end", F.when(first, F.col("train_end")).otherwise(F.least(F.col("test_start") + embargo, F.col("train_end"))).cast("long"))
    return f.where(F.col("train_end") - (F.col("hole_end") - F.col("hole_start")) >= min_train).where(F.col("test_start") < n)


def fold_rows(rows: DataFrame, folds: DataFrame, pos: str = "pos") -> DataFrame:
    """rows by fold and role (train or test); folds: a handful."""
    x = rows.crossJoin(F.broadcast(folds))
    p = F.col(pos)
    role = F.when(p.between(F.col("test_start"), F.col("test_end") - 1), "test").when((p < F.col("train_end")) & ~p.between(F.col("hole_start"), F.col("hole_end") - 1), "train")
    return x.withColumn("role", role).where("role is not null")


def hmm_features(bench: DataFrame, credit: DataFrame) -> DataFrame:
    """symbol, date, x1 (return), x2 (volatility), x3 (credit change)."""
    b = bench.withColumn("symbol", F.lit("*")).withColumnRenamed("bench", "close").join(credit, "date")
    b = b.withColumn("x1", n_bar_return("close", 1)).withColumn("x2", rolling(F.stddev_samp, "x1", 21) * 252**0.5)
    from tidemark.operators.windows import series

    b = b.withColumn("x3", F.col("credit") - F.lag("credit", 63).over(series()))
    return b.select("symbol", "date", "x1", "x2", "x3").dropna()


def fit_hmm(x: np.ndarray, states: int = 3, steps: int = 60, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, move, mean, var) of a diagonal Gaussian HMM on standardised rows, by expectation-maximisation."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    order = np.argsort(x[:, 0] + 1e-9 * rng.random(n))
    mean = np.stack([x[part].mean(0) for part in np.array_split(order, states)])
    var, move, start = np.ones((states, d)), np.full((states, states), 0.05 / max(1, states - 1)), np.full(states, 1 / states)
    np.fill_diagonal(move, 0.95)
    for _ in range(steps):
        gamma, pair, _ = _posterior(x, start, move, mean, var)
        start, move = gamma[0] + 1e-6, pair + 1e-3
        start, move = start / start.sum(), move / move.sum(1, keepdims=True)
        w = gamma.sum(0)[:, None] + 1e-9
        mean = gamma.T @ x / w
        var = np.maximum(gamma.T @ (x * x) / w - mean * mean, 1e-3)
    return start, move, mean, var


def _posterior(x, start, move, mean, var):
    """(state probabilities, expected transitions, log likelihood), by scaled forward and backward passes."""
    n, k = len(x), len(start)
    log_b = -0.5 * (((x[:, None] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
    top = log_b.max(1, keepdims=True)
    b = np.exp(log_b - top)
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        a = (start if t == 0 else alpha[t - 1] @ move) * b[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    pair = move * (alpha[:-1].T @ ((b[1:] * beta[1:]) / scale[1:, None]))
    return gamma / gamma.sum(1, keepdims=True), pair, float(np.log(scale).sum() + top.sum())


def hmm_regimes(features: DataFrame, states: int = 3, least: int = 500) -> DataFrame:
    """symbol, date, state: each series' most probable states, numbered by mean return; series that are too short are left out.

    One series is a few thousand days, so one task fits one series.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        x = rows[["x1", "x2", "x3"]].to_numpy(float)
        if len(x) < least:
            return pd.DataFrame({"symbol": [], "date": [], "state": []}).astype({"symbol": str, "state": int})
        sd = x.std(0)
        z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
        start, move, mean, var = fit_hmm(z, states)
        gamma, _, _ = _posterior(z, start, move, mean, var)
        rank = np.argsort(np.argsort(mean[:, 0]))
        return pd.DataFrame({"symbol": rows["symbol"], "date": rows["date"], "state": rank[gamma.argmax(1)]})

    return features.groupBy("symbol").applyInPandas(run, "symbol string, date date, state long")


def hmm_walk_forward(features: DataFrame, splits: int = 3, embargo: int = 21, min_train: int = 300, states: int = 3) -> DataFrame:
    """symbol, n_folds, mean_oos_loglik: average log likelihood per row out of sample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("date")[["x1", "x2", "x3"]].to_numpy(float)
        size, scores = len(x) // (splits + 1), []
        for k in range(1, splits + 1):
            a, b = k * size, len(x) if k == splits else (k + 1) * size
            train = np.arange(0, a)
            if len(train) < min_train:
                continue
            mu, sd = x[train].mean(0), x[train].std(0)
            sd = np.where(sd > 0, sd, 1)
            model = fit_hmm((x[train] - mu) / sd, states)
            scores.append(_posterior((x[a:b] - mu) / sd, *model)[2] / (b - a))
        return pd.DataFrame({"symbol": [rows["symbol"].iloc[0]], "n_folds": [len(scores)], "mean_oos_loglik": [float(np.mean(scores)) if scores else None]})

    return features.groupBy("symbol").applyInPandas(run, "symbol string, n_folds long, mean_oos_loglik double")
