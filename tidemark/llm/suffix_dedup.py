"""Removal of repeated byte strings over the whole corpus, by suffix sorting of shards.

Whether the 400 bytes at a position occur elsewhere is decided among the positions that
could be equal. A position's anchor is the least hash of the 160-byte grams in its 400
bytes (the leftmost of equals), so equal strings have equal anchors. Consecutive positions with
one anchor form a run of about 120; its context is the bytes they cover.

* Anchors that occur once end here: most of a corpus without copies.
* Contexts that occur twice or more, byte for byte, repeat as a whole: the inside of copies.
* Different contexts of one anchor, the edges of copies, go to the shard of their anchor,
  once each. A shard's suffixes are sorted by external induced sorting with common-prefix
  values (induced_sort), which handles a shard far larger than memory; positions whose
  common prefix with a neighbour is 400 are repeated.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, without
from tidemark.llm.induced_sort import repeated_positions

LENGTH = 400
GRAM = 160
#: Bytes of context for one shard, on average; and what its sort may hold in memory.
SHARD_BYTES = 2 << 20
MEMORY = 128 << 20
#: An anchor with more occurrences than this is counted by context before it is moved.
HOT = 4096
RUN_BYTES = 1 << 20
#: Contexts or found runs that a shard's task lists in memory.
ROWS = 1 << 16
OUT = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POSITION = (1 << 22) - 1
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _power or len(_power["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(max(n, 2 * RUN_BYTES), base, np.uint64)
            step[0] = 1
            _power[name] = np.multiply.accumulate(step)
    return _power["up"][:n], _power["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by running minimums from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(pieces: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(piece, first, last, anchor hash) of each run of positions, and the joined pieces; first and last in the joined bytes."""
    data = b"".join(pieces)
    n = len(data)
    if n < length:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64), data)
    sums = np.zeros(n + 1, np.uint64)
    up, down = _powers(n)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + _U(1)) * up, out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    del sums
    marked = (grams & ~_U(_POSITION)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(marked, length - gram + 1) & _U(_POSITION)).astype(np.int64)
    ends = np.cumsum([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    at = np.arange(n - length + 1)
    inside = piece[: n - length + 1] == piece[length - 1 :]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    first, last = at[begins], at[stops]
    del ends
    return piece[first], first, last, grams[anchor[first]], data


def _runs_batch(keys: list, texts: list, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    group: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        which, first, last, anchors, data = runs_of([g[2] for g in group], length, gram)
        if not len(which):
            return
        offsets = np.cumsum([0] + [len(g[2]) for g in group[:-1]])
        shift = np.array([g[1] for g in group]) - offsets
        digests = np.array([hashlib.blake2b(data[a : b + length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist())], "S16")
        # runs of one context that follow or overlap in a document (periodic text) are one row
        order = np.lexsort((first, anchors, which))
        which, first, last, anchors, digests = which[order], first[order], last[order], anchors[order], digests[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (anchors[1:] != anchors[:-1]) | (digests[1:] != digests[:-1]) | (first[1:] > last[:-1] + length)
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(which)))
        stop = last[np.append(begin[1:], len(which)) - 1]
        which, first, n, anchors = which[begin], first[begin], (last - first)[begin], anchors[begin]
        digests = [d.ljust(16, b"\0") for d in digests[begin].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.view(np.int64)), pa.array(digests, pa.binary()), pa.array([group[i][0] for i in which.tolist()], pa.binary()),
             pa.array(first + shift[which]), pa.array(stop + shift[which]), pa.array(n), pa.array(count)],
            ["anchor", "ctx", "doc", "a", "b", "n", "c"],
        )

    for key, text in zip(keys, texts):
        for at in range(0, max(1, len(text) - length + 1), RUN_BYTES):  # pieces of a long text overlap, positions don't
            piece = text[at : at + RUN_BYTES + length - 1]
            if len(piece) < length:
                continue
            group.append((key, at, piece))
            size += len(piece)
            if size >= RUN_BYTES:
                yield from flush()
                group, size = [], 0
    if group:
        yield from flush()


def _counted(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs whose anchor occurs again, with copies (occurrences of the context), contexts (different ones of the anchor) and
    lead (one row of each context)."""
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("anchor")
    often = scratch.small(often, "hot-anchors")  # at most one for every HOT runs
    plain = runs.join(often, "anchor", "left_anti")
    by_ctx = W.partitionBy("anchor", "ctx")
    plain = (
        plain.withColumn("rn", F.row_number().over(by_ctx.orderBy("doc", "a")))
        .withColumn("all", F.sum("c").over(W.partitionBy("anchor")))
        .where(F.col("all") > 1)
        .withColumn("copies", F.sum("c").over(by_ctx))
        .withColumn("contexts", F.sum(F.when(F.col("rn") == 1, 1)).over(W.partitionBy("anchor")))
        .select("anchor", "ctx", "doc", "a", "b", "n", "copies", "contexts", (F.col("rn") == 1).alias("lead"))
    )
    if often.isEmpty():
        return plain
    hot = runs.join(often, "anchor").groupBy("anchor", "ctx", "doc", "a", "b", "n").agg(F.sum("c").alias("c"))  # equal documents become one
    hot = scratch.table(hot, "hot-runs")
    per = hot.groupBy("anchor", "ctx").agg(F.sum("c").alias("copies"), F.min(F.struct("doc", "a")).alias("first"))
    per = scratch.table(per, "hot-contexts")
    many = scratch.small(per.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")), "hot-counts")
    hot = hot.join(scratch.small(per.join(many, "anchor"), "hot-totals"), ["anchor", "ctx"])
    return plain.unionByName(hot.select("anchor", "ctx", "doc", "a", "b", "n", "copies", "contexts", (F.struct("doc", "a") == F.col("first")).alias("lead")))


class _ShardText:
    """A shard's contexts one after another, each with a separator; in memory, beyond the budget in a task-private spill file."""

    def __init__(self) -> None:
        self.held, self.file = bytearray(), None

    def append(self, context: bytes) -> None:
        self.held += (np.frombuffer(context, np.uint8).astype(np.int16) + 1).tobytes() + b"\0\0"
        if len(self.held) > MEMORY:
            if self.file is None:
                self.file = tempfile.NamedTemporaryFile(prefix="shard-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            self.file.write(self.held)
            self.held = bytearray()

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(self.held, np.int16)
        self.file.write(self.held)
        self.file.flush()
        self.held = bytearray()
        return np.memmap(self.file.name, np.int16, "r", shape=(self.file.tell() // 2,))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _ShardRows:
    """(doc, first, bytes) of a shard's contexts in order; beyond ROWS in a task-private spill file."""

    def __init__(self) -> None:
        self.held, self.file, self.dumps = [], None, 0

    def append(self, row: tuple) -> None:
        self.held.append(row)
        if len(self.held) >= ROWS:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="rows-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            pickle.dump(self.held, self.file)
            self.held, self.dumps = [], self.dumps + 1

    def __bool__(self) -> bool:
        return bool(self.held or self.dumps)

    def __iter__(self) -> Iterator[tuple]:
        if self.file is not None:
            self.file.seek(0)
            for _ in range(self.dumps):
                yield from pickle.load(self.file)
        yield from self.held

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _sort_shards(length: int):
    def found(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], ["doc", "a", "b"])

    def sort(text: _ShardText, rows: _ShardRows) -> Iterator[pa.RecordBatch]:
        flags = repeated_positions(text.array(), length, MEMORY)
        out: list[tuple] = []
        at = 0
        for doc, a, n in rows:
            hit = np.flatnonzero(np.diff(flags[at : at + n - length + 1].view(np.int8), prepend=0, append=0))
            out += [(doc, a + int(s), a + int(e) - 1) for s, e in zip(hit[0::2], hit[1::2])]
            at += n + 1
            if len(out) >= ROWS:
                yield found(out)
                out = []
        if out:
            yield found(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, text = None, _ShardRows(), _ShardText()
        try:
            for batch in batches:
                for s, doc, a, context in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if s != shard and rows:
                        yield from sort(text, rows)
                        text.close()
                        rows.close()
                        rows, text = _ShardRows(), _ShardText()
                    shard = s
                    text.append(context)
                    rows.append((doc, a, len(context)))
            if rows:
                yield from sort(text, rows)
        finally:
            text.close()
            rows.close()

    return run


def repeated_runs(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts (doc binary digest, text binary; one row per document) -> (doc, a, b): the strings that start at a..b cover
    nothing but bytes of strings that start elsewhere, too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield from _runs_batch(part.column(0).to_pylist(), part.column(1).to_pylist(), length, gram)

    long_enough = texts.where(F.octet_length("text") >= length)
    runs = scratch.table(long_enough.select("doc", "text").mapInArrow(find, "anchor long, ctx binary, doc binary, a long, b long, n long, c long"), "runs")
    again = scratch.table(_counted(runs, scratch).where("copies > 1 or (contexts > 1 and lead)"), "repeated-anchors")
    whole = again.where("copies > 1").select("doc", "a", "b").distinct()
    edges = again.where("contexts > 1 and lead").withColumn("b", F.col("a") + F.col("n"))
    total = edges.agg(F.sum(F.col("b") - F.col("a") + length)).first()[0] or 0
    shards = max(1, round(total / SHARD_BYTES))
    shard = F.expr(f"pmod(xxhash64(anchor), {shards})")
    wanted = edges.groupBy("doc").agg(F.collect_list(F.struct(shard.alias("shard"), "a", "b")).alias("parts"))  # bounded by the document's length
    listed = scratch.small(wanted.select("doc"), "edge-documents")  # where it is small, only their texts are moved, one of each
    source = long_enough.select("doc", "text").join(listed, "doc", "left_semi").dropDuplicates(["doc"])
    cut = F.transform("parts", lambda p: F.struct(p["shard"].alias("shard"), p["a"].alias("a"), F.substring(F.col("text"), (p["a"] + 1).cast("int"), (p["b"] - p["a"] + length).cast("int")).alias("context")))
    contexts = source.join(wanted, "doc").select("doc", F.explode(cut).alias("c")).select("c.shard", "doc", "c.a", "c.context")
    dealt = contexts.repartition(shards, "shard").sortWithinPartitions("shard", "doc", "a")
    sorted_ = scratch.table(dealt.mapInArrow(_sort_shards(length), "doc binary, a long, b long"), "sorted")
    return whole.unionByName(sorted_)


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, list[bytes]]:
    """(bytes removed, maximal runs, what is kept) for sorted half-open spans that may overlap."""
    removed = runs = at = 0
    end = -1
    kept = []
    for a, b in spans:
        if a > end:
            runs += 1
            kept.append(text[at:a])
        end = max(end, b)
        at = max(at, b)
    kept.append(text[at:])
    left = sum(map(len, kept))
    removed = len(text) - left
    return removed, runs, kept


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, scratch: Scratch | None = None, with_text: bool = True) -> DataFrame:
    """docs without its text, with n_bytes (UTF-8), n_removed, n_spans (maximal removed runs), kept_sha256 and (with_text)
    kept_bytes, the remaining bytes.

    Every byte covered by a string of `length` bytes that also starts anywhere else in docs goes; strings are
    judged on the input, and never cross documents.
    * A null text is empty; texts shorter than length keep all. Equal texts and repeated rows repeat each
      other, so of texts of at least length bytes no copy is kept.
    * An empty table gives no rows. Input columns named like an output are replaced.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be in 1..length")
    scratch = scratch or Scratch(docs.sparkSession)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_text else [])]
    rows = without(docs, [*OUT, "kept_sha256", "__doc", "__spans", "__bytes"])
    rows = rows.withColumn("__bytes", F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).drop(text_col)
    rows = rows.withColumn("__doc", F.unhex(F.md5("__bytes")))
    found = repeated_runs(rows.select(F.col("__doc").alias("doc"), F.col("__bytes").alias("text")), scratch, length, gram)
    spans = found.groupBy(F.col("doc").alias("__doc")).agg(F.sort_array(F.collect_list(F.struct("a", (F.col("b") + length).alias("b")))).alias("__spans"))
    spans = scratch.table(spans, "spans")
    joined = rows.join(spans, "__doc", "left").drop("__doc")
    keep = [c for c in joined.columns if c not in ("__bytes", "__spans")]
    joined = joined.select(*[F.col(f"`{c}`") for c in keep], "__bytes", "__spans")
    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_bytes": pa.binary()}
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in keep] + [f"{c} {sql[types[c]]}" for c in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for text, found in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist()):
                    removed, n, kept = cut_text(text, [(s["a"], s["b"]) for s in found or []])
                    left = b"".join(kept)
                    out.append((len(text), removed, n, hashlib.sha256(left).hexdigest(), left)[: len(names)])
                arrays = [pa.array(c, types[k]) for k, c in zip(names, zip(*out))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *arrays], [*keep, *names])

    return joined.mapInArrow(cut, schema)
