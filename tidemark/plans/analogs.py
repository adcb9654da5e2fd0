"""Nearest earlier rows by feature distance, and their thinning."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.thinning import thin_by_distance


#: Query positions of a symbol that one join key holds.
BLOCK = 128
#: Queries and rows of a cell, which one call of the vector search compares, and queries compared at once in it.
QUERY_BLOCK, ROW_BLOCK, CHUNK = 512, 4096, 64


def distance(a: Column, b: Column, scale: Column | None = None) -> Column:
    """Euclidean distance of two arrays, each difference divided by scale."""
    parts = F.arrays_zip(a.alias("a"), b.alias("b"), (scale if scale is not None else F.transform(a, lambda x: F.lit(1.0))).alias("s"))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.pow((p["a"] - p["b"]) / p["s"], 2)))


def _spread_out(name: str, dims: int, out: str) -> list[Column]:
    """The elements of an array column without nulls, as columns that Spark knows to hold none."""
    return [F.coalesce(F.col(name)[i], F.lit(0.0)).alias(f"{out}{i}") for i in range(dims)]


def _written_out(dims: int, scaled: bool) -> Column:
    """Distance of columns x0.. and q0.., each difference times w0... Without null checks it is small enough for the JVM to compile."""
    total = F.lit(0.0)
    for i in range(dims):
        diff = F.col(f"x{i}") - F.col(f"q{i}")
        diff = diff * F.col(f"w{i}") if scaled else diff
        total = total + diff * diff
    return F.sqrt(total)


def nearest_earlier(rows: DataFrame, queries: DataFrame, k: int, scaled: bool = False, dims: int | None = None, block: int = BLOCK) -> DataFrame:
    """rows (symbol, pos, x), queries (the same, with scale if scaled) -> symbol, query_pos, pos, dist, rk: the k nearest rows before each query.

    A stated set of queries against the earlier rows of the same symbol; each query keeps a bounded top k.
    dims: the arrays' length, where it is known and none of them holds a null.
    The join's key is the symbol and a block of query positions, so a long series is many tasks, and a
    block meets only the rows before its end.
    """
    part = lambda c: F.floor(F.col(c) / block)
    q = queries.withColumnRenamed("pos", "query_pos").withColumn("block", part("query_pos"))
    if dims:
        scale = [(F.lit(1.0) / F.coalesce(F.col("scale")[i], F.lit(1.0))).alias(f"w{i}") for i in range(dims)] if scaled else []
        q = q.select("symbol", "query_pos", "block", *_spread_out("x", dims, "q"), *scale)
        own, d = _spread_out("x", dims, "x"), _written_out(dims, scaled)
        q = q.select(*[F.coalesce(c, F.lit(1.0)).alias(c) if c[0] == "w" else F.col(c) for c in q.columns])
    else:
        q = q.select("symbol", "query_pos", "block", F.col("x").alias("qx"), *(["scale"] if scaled else []))
        own, d = [F.col("x")], distance(F.col("x"), F.col("qx"), F.col("scale") if scaled else None)
    blocks = queries.select("symbol", part("pos").alias("block")).distinct()
    spread = rows.select("symbol", "pos", *own).join(blocks, "symbol").where(part("pos") <= F.col("block"))
    # a stated number of tasks: the few bytes that go in say nothing of the pairs that come out, so Spark would merge them
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = spread.repartition(tasks, "symbol", "block").join(q.repartition(tasks, "symbol", "block"), ["symbol", "block"]).where("pos < query_pos")
    pairs = pairs.select("symbol", "block", "query_pos", "pos", d.alias("dist"))
    pairs = pairs if dims else pairs.where("dist is not null")
    rk = F.row_number().over(W.partitionBy("symbol", "block", "query_pos").orderBy("dist", "pos"))
    return pairs.withColumn("rk", rk).where(F.col("rk") <= k).drop("block")


def nearest_vectors(rows: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """rows (pos, x), queries (the same) -> query_pos, pos, dist, rk: the k nearest rows before each query, ties by pos, all rows compared.

    For one series of long vectors. Queries and rows are cut into blocks of about equal size at quantiles of
    pos; a cell is a block of queries and a block of rows, and gives each query's k nearest of its rows. So a task
    holds two blocks, whatever the table's size or the gaps in pos. Beyond 4 blocks of rows, blocks grow (to 16 times
    row_block at most), as what cells give grows with the number of blocks.
    A null pos or x, or an x that holds a null, meets nothing; vectors meet those of their own length.
    """
    whole = lambda df: df.where(F.col("pos").isNotNull() & F.expr("forall(x, v -> v is not null)")).select("pos", F.col("x").cast("array<double>").alias("x"))
    rows, queries, kind = whole(rows), whole(queries), rows.schema["pos"].dataType.simpleString()
    of_query, of_row = _blocks(queries, query_block, query_block), _blocks(rows, row_block, 16 * row_block)
    last_query, last_row = of_query[-1], of_row[-1]
    # blocks follow pos, so a query's earlier rows are in the blocks up to its own place among the rows
    spread = rows.select("pos", "x", F.size("x").alias("dims"), F.explode(F.sequence(of_query[0]("pos"), F.lit(last_query))).alias("qb"), of_row[0]("pos").alias("rb"))
    asked = queries.select("pos", "x", F.size("x").alias("dims"), of_query[0]("pos").alias("qb"), F.explode(F.sequence(F.lit(0), of_row[0]("pos"))).alias("rb"))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, (last_query + 1) * (last_row + 1))
    key = ["dims", "qb", "rb"]
    cells = asked.repartition(tasks, *key).groupBy(*key).cogroup(spread.repartition(tasks, *key).groupBy(*key))
    near = cells.applyInArrow(_cell_search(k), f"query_pos {kind}, pos {kind}, dist double")
    rk = F.row_number().over(W.partitionBy("query_pos").orderBy("dist", "pos"))
    return near.withColumn("rk", rk).where(F.col("rk") <= k)


def _blocks(df: DataFrame, size: int, most: int) -> tuple[Callable[[str], Column], int]:
    """The block of a position, ascending with it; and the last block. Each holds about `size` of df's rows, up to `most` if there are over 4."""
    n = df.count()
    n = math.ceil(n / min(max(size, math.ceil(n / 4)), most))
    bounds = sorted(set(df.approxQuantile("pos", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    if not bounds:
        return lambda c: F.lit(0), 0
    return lambda c: F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(c))), len(bounds)


def _cell_search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Searches a cell: its queries (pos, x) against its rows (pos, x) -> query_pos, pos, dist, at most k a query."""

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        pos, query_pos = rows["pos"].to_numpy(), queries["pos"].to_numpy()
        x, q = _matrix(rows), _matrix(queries)
        found = [(a + at, b, d) for a in range(0, len(q) if len(x) else 0, CHUNK) for at, b, d in [_nearest(q[a : a + CHUNK], query_pos[a : a + CHUNK], x, pos, k)]]
        at, b, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_pos": queries["pos"].take(pa.array(at)).combine_chunks(), "pos": rows["pos"].take(pa.array(b)).combine_chunks(), "dist": d})

    return search


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t["x"].combine_chunks()
    values = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(t), -1) if len(t) and len(values) else np.zeros((len(t), 0))


def _nearest(q: np.ndarray, query_pos: np.ndarray, x: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes into q and x, and distances: of the rows before each query the k first by (distance, pos).

    A matrix product rules rows out by a distance that is right up to a stated error; the others' distances are
    summed element by element, as SQL sums them, so that ranks and ties are SQL's.
    """
    near = pos[None, :] < query_pos[:, None]
    if len(x) > k:
        with np.errstate(all="ignore"):
            xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
            rough = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
            error = 16 * (q.shape[1] + 8) * np.finfo(float).eps * (qq + xx.max()) + 1e-290
        if np.isfinite(error).all():  # else nothing is ruled out
            rough[~near] = np.inf
            near &= rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error)[:, None]
    at, b = np.nonzero(near)
    d = np.zeros(len(at))
    with np.errstate(all="ignore"):
        for i in range(q.shape[1]):
            step = x[b, i] - q[at, i]
            d += step * step
    d = np.sqrt(d)
    order = np.lexsort((pos[b], d, at))
    at, b, d = at[order], b[order], d[order]
    first = np.searchsorted(at, np.arange(len(q)))
    top = np.arange(len(at)) - first[at] < k
    return at[top], b[top], d[top]


def thin_nearest(near: DataFrame, gap: int, most: int, closest: int = 20, by: Sequence[str] = ("symbol", "query_pos")) -> DataFrame:
    """by (symbol, query_pos), kept, mean_dist: the nearest first, gap rows from all kept ones, at most `most`; and the mean distance of the closest."""
    g = near.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rk", "pos", "dist"))).alias("l"))
    kept = thin_by_distance(F.transform("l", lambda s: s["pos"].cast("bigint")), gap, most)
    total = F.aggregate(F.slice("l", 1, closest), F.lit(0.0), lambda acc, s: acc + s["dist"])
    return g.select(*by, kept.alias("kept"), (total / F.least(F.size("l"), F.lit(closest))).alias("mean_dist"))


def scales(rows: DataFrame, features: list[str], w) -> DataFrame:
    """rows with scale: the expanding population deviation of each feature, 1 where it is null or 0 (a constant feature adds no distance)."""
    frame = w.rowsBetween(W.unboundedPreceding, 0)
    sd = [F.stddev_pop(c).over(frame) for c in features]
    return rows.withColumn("scale", F.array(*[F.when(s.isNull() | (s == 0) | F.isnan(s), 1.0).otherwise(s) for s in sd]))
