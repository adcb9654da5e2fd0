"""Sharding by extendible hashing, in DataFrame operations only.

A row's address is the first 60 bits of md5(id, NUL, text). A bucket is a prefix of
those bits. The directory starts with the empty prefix; a bucket over the byte limit
is split on the next bit, the others stay, until every bucket fits.

Byte sums of a prefix only shrink as it grows, so the bucket of a row is its shortest
prefix whose sum fits. Sums are taken for a band of depths at once from a histogram of
cells (one row per cell, not per document); only what is still too large at the
band's end is summed again, deeper.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, without

BITS = 60
OUT = ["n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_docs"]


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), text)
    return docs.withColumns(
        {
            "__h": F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"),
            "__b": F.octet_length(text).cast("long"),
        }
    )


def _prefix(h, depth: int):
    return F.shiftright(h, BITS - depth) if depth else F.lit(0).cast("long")


def directory(rows: DataFrame, limit_bytes: int, scratch: Scratch) -> tuple[DataFrame, list[int], bool]:
    """Buckets (depth, prefix, shard_bytes, shard_docs), their depths, and whether any is over the limit at 60 bits.

    rows: __h, __b.
    """
    total = rows.agg(F.sum("__b")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + 5)
    pending, found, over = None, [], False
    while True:
        part = rows
        if pending is not None:
            part = rows.withColumn("prefix", _prefix(F.col("__h"), low)).join(pending, "prefix", "left_semi")
        cells = part.groupBy(_prefix(F.col("__h"), high).alias("cell")).agg(F.sum("__b").alias("b"), F.count(F.lit(1)).alias("n"))
        sums = (
            cells.select("b", "n", "cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        )
        sums = scratch.table(sums, "sums")
        large = sums.where(F.col("shard_bytes") > limit_bytes)
        fits = sums.where((F.col("shard_bytes") <= limit_bytes) | ((F.col("depth") == BITS) & F.lit(high == BITS)))
        split = large.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        inner = fits.withColumn("up", F.shiftright("prefix", 1)).join(split, ["depth", "up"], "left_semi").drop("up")
        found.append(inner if low else inner.unionByName(fits.where("depth = 0")))
        last = large.where(F.col("depth") == high)
        if last.isEmpty():
            break
        if high == BITS:
            over = True
            break
        pending, low, high = last.select("prefix"), high, min(BITS, high + 12)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = scratch.table(out.select("depth", "prefix", "shard_bytes", "shard_docs"), "directory")
    return out, sorted(r[0] for r in out.select("depth").distinct().collect()), over


def assign_shards(
    docs: DataFrame,
    limit_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """docs with n_bytes (UTF-8 bytes of the text), shard_id, shard_depth, shard_bytes, shard_docs.

    * A null id counts as the empty string, a null text as empty (0 bytes).
    * Rows equal in id and text share all 60 bits. If such a bucket is over the limit,
      it becomes an overflow chain: shards `<bits>+<link>`, filled in order, each within
      the limit (a document above half the limit is a link of its own).
    * A single document over the limit is a shard of its own, the only kind over the limit.
    * An empty table gives no rows. Input columns named like an output are replaced.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    scratch = scratch or Scratch(docs.sparkSession)
    rows = _addressed(without(docs, [*OUT, "__h", "__b"]), id_col, text_col)
    table, depths, over = directory(rows.select("__h", "__b"), limit_bytes, scratch)
    out = rows
    for d in depths:  # as many as there are different depths: a handful; no shuffle while the directory is small
        part = table.where(F.col("depth") == d).select(
            F.col("prefix").alias(f"__p{d}"), F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias(f"__s{d}")
        )
        out = out.withColumn(f"__p{d}", _prefix(F.col("__h"), d)).join(part, f"__p{d}", "left").drop(f"__p{d}")
    at = F.coalesce(*[F.col(f"__s{d}") for d in depths]) if depths else F.lit(None).cast("struct<depth:int,prefix:long,shard_bytes:long,shard_docs:long>")
    out = out.withColumn("__s", at)
    bits = F.when(F.col("__s.depth") == 0, "").otherwise(F.expr("lpad(bin(__s.prefix), __s.depth, '0')"))
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("__h", "__b")]
    final = out.select(
        *keep,
        F.col("__b").alias("n_bytes"),
        F.concat(F.lit("b"), bits).alias("shard_id"),
        F.col("__s.depth").cast("int").alias("shard_depth"),
        F.col("__s.shard_bytes").alias("shard_bytes"),
        F.col("__s.shard_docs").alias("shard_docs"),
    )
    return _overflow(final, limit_bytes) if over else final


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Cuts buckets of equal addresses that are over the limit into links within it."""
    fine = rows.where(F.col("shard_bytes") <= limit)
    full = rows.where(F.col("shard_bytes") > limit)
    half = max(1, limit // 2)
    small = F.col("n_bytes") <= half
    order = W.partitionBy("shard_id", small).orderBy("n_bytes")
    before = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    link = F.when(small, F.concat(F.lit("s"), F.floor(before / half).cast("string"))).otherwise(
        F.concat(F.lit("l"), F.row_number().over(order).cast("string"))
    )
    full = full.withColumn("shard_id", F.concat("shard_id", F.lit("+"), link))
    own = W.partitionBy("shard_id")
    full = full.withColumn("shard_bytes", F.sum("n_bytes").over(own)).withColumn("shard_docs", F.count(F.lit(1)).over(own))
    return fine.unionByName(full)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows of a shard written by one task (it fits the byte limit)."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
