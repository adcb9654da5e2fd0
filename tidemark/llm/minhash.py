"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Documents (text words lower-cased, distinct five-word shingles) with equal shingle
   sets form one class. Each class gets 128 minimums, cut into 32 bands of 4.
2. Classes that share a band are candidates. Each is first compared with the best connected
   member of the band's bucket, its lead, in groups of a lead and GROUP_DOCS candidates.
3. A bucket is open if its other members are not all connected by then. Classes of open
   buckets that hang together are compared in one task if they are few; beyond that in each
   bucket by blocks, those outside the bucket's largest component with all the others.
4. A comparison looks at 32 minimums at a time and prunes as soon as the posterior
   probability of a similarity at the threshold is below MISS; what survives is verified
   on the full shingle sets. Pairs are never rows of a table.

A pair at the threshold shares no band with probability (1 - 0.75**4)**32 = 5e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, without

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
THRESHOLD = 75
#: Chosen miss probability of the sequential test, at each batch.
MISS = 1e-7
#: Classes and shingles that are verified together; what is more is dealt into blocks of about this size.
GROUP_DOCS, GROUP_SHINGLES = 256, 1_000_000
#: Texts are hashed in runs of about this many bytes.
RUN_BYTES = 1 << 21
OUT = ["n_shingles", "component_id", "kept"]

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        step = np.full(max(n, RUN_BYTES + 4096), _BASE if which == "up" else _INVERSE)
        step[0] = 1
        have = _powers[which] = np.multiply.accumulate(step)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; no words: an empty array."""
    out: list[np.ndarray] = []
    run: list[bytes] = []
    size = 0
    for text in texts:
        run.append((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        size += len(run[-1]) + 1
        if size >= RUN_BYTES:
            out += _sets_of_run(run)
            run, size = [], 0
    return out + (_sets_of_run(run) if run else [])


def _sets_of_run(run: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    n = len(data)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is white space, so each word ends
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power("up", n), out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * _power("down", n)[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    limits = np.searchsorted(starts, np.cumsum([len(b) + 1 for b in run]))
    k = len(hashes) - SHINGLE + 1
    if k > 0:
        grams = hashes[:k].copy()
        for i in range(1, SHINGLE):
            grams = grams * _U(0xC2B2AE3D27D4EB4F) + hashes[i : i + k]
        grams = _mix(grams)
    out, at = [], 0
    for end in limits.tolist():
        w = end - at
        if w >= SHINGLE:
            out.append(np.unique(grams[at : end - SHINGLE + 1]))
        elif w:
            h = np.array([w], np.uint64)
            for x in range(at, end):
                h = _mix(h * _U(0xC2B2AE3D27D4EB4F) + hashes[x])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, HASHES) minimums of non-empty sets, the upper halves of 64-bit products."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size < 1 << 16 or end == at):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        begins = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        product = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, _MULTIPLIERS[k], out=product)
            out[at:end, k] = np.minimum.reduceat(product, begins) >> _U(32)
        at = end
    return out


def bands_of(sigs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) int64 bucket keys, different for each band."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), (len(sigs), BANDS)).copy()
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        h = _mix(h * _U(0xC2B2AE3D27D4EB4F) + parts[:, :, r])
    return h.view(np.int64)


def _least_matches(threshold: float, miss: float) -> list[int]:
    """For 32, 64, ... compared minimums: the fewest matches that keep a pair.

    With a uniform prior the similarity given m of n matches is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


class _Group:
    """Non-empty shingle sets that are compared with each other."""

    def __init__(self, sets: list[np.ndarray], threshold: int = THRESHOLD, miss: float = MISS):
        self.threshold, self.least = threshold, _least_matches(threshold / 100, miss)
        self.sigs = signatures(sets)
        self.bands = bands_of(self.sigs)
        self.sizes = np.array([len(s) for s in sets])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flag = np.zeros(int(self.ids.max()) + 1, bool)

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others (indexes, sharing a band with x) that are as similar to x as the threshold asks."""
        small, large = np.minimum(self.sizes[others], self.sizes[x]), np.maximum(self.sizes[others], self.sizes[x])
        cand = others[100 * small >= self.threshold * large]  # no larger similarity than the ratio of the sizes
        matches = np.zeros(len(cand), np.int64)
        for b, low in enumerate(self.least):
            if not len(cand):
                return cand
            part = slice(b * BATCH, (b + 1) * BATCH)
            matches += (self.sigs[cand, part] == self.sigs[x, part]).sum(1)
            keep = matches >= low
            cand, matches = cand[keep], matches[keep]
        mine = self.ids[self.begins[x] : self.begins[x + 1]]
        self.flag[mine] = True
        both = np.array([np.count_nonzero(self.flag[self.ids[self.begins[y] : self.begins[y + 1]]]) for y in cand], np.int64)
        self.flag[mine] = False
        return cand[100 * both >= self.threshold * (self.sizes[cand] + self.sizes[x] - both)]


def group_links(sets: list[np.ndarray], known: np.ndarray | None = None, threshold: int = THRESHOLD, miss: float = MISS) -> np.ndarray:
    """For each of a group's non-empty sets the index of its component's first member; known: components found before."""
    n = len(sets)
    comp = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    if n < 2:
        return np.arange(n)
    group = _Group(sets, threshold, miss)
    keys, inverse, counts = np.unique(group.bands, return_inverse=True, return_counts=True)
    degree = counts[inverse.reshape(group.bands.shape)].sum(1)
    done = np.zeros(n, bool)
    for x in np.lexsort((np.arange(n), -degree)):  # the best connected first: most get linked to it
        done[x] = True
        open_ = np.flatnonzero(~done & (comp != comp[x]))
        if len(open_):
            linked = group.linked(x, open_[(group.bands[open_] == group.bands[x]).any(1)])
            if len(linked):
                comp[np.isin(comp, comp[linked])] = comp[x]
    first = {}
    for i, c in enumerate(comp.tolist()):
        first.setdefault(c, i)
    return np.array([first[c] for c in comp.tolist()])


def bucket_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, known: np.ndarray, bucket: int) -> list[tuple[int, int]]:
    """Links between sets of a bucket marked left and those marked right that are not known to be connected.

    A pair is compared in the first bucket that it shares, and not again in later ones.
    """
    group = _Group(sets)
    comp = np.unique(known, return_inverse=True)[1]
    band = int(np.flatnonzero((group.bands == bucket).any(0))[0])
    out: list[tuple[int, int]] = []
    for x in np.flatnonzero(left):
        other = np.flatnonzero(right & (comp != comp[x]))
        other = other[~(group.bands[other, :band] == group.bands[x, :band]).any(1)]
        for y in group.linked(x, other).tolist():
            out.append((int(x), y))
            comp[comp == comp[y]] = comp[x]
    return out


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each u has one v that is no u itself: then each v is the least of what it is connected to."""
    rows, nodes = pairs.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return rows == nodes and pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) of comparable ids -> (node, root), root the least id reachable; by large and small stars.

    Every round is written; a node's neighbours are only reduced and joined, never gathered.
    """
    pairs = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a hub's rows meet its minimum in a join that Spark can split
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, "large-star")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        pairs = scratch.table(small, "small-star")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _sketch(rows: DataFrame) -> DataFrame:
    """rows (id, text_key, text) -> id, text_key, n, cls, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(2).to_pylist())
                full = [s for s in sets if len(s)]
                keys = iter(bands_of(signatures(full)).tolist() if full else [])
                cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()),
                     pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    ["id", "text_key", "n", "cls", "bands"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_key binary, n long, cls binary, bands array<long>")


_LINKS = "a binary, b binary"


def _verify_star(group: pd.DataFrame) -> pd.DataFrame:
    """A lead and candidates."""
    group = group.sort_values("is_lead", kind="stable", ascending=False)
    linked = _Group(shingle_sets(group["text"].tolist())).linked(0, np.arange(1, len(group)))
    cls = group["cls"].tolist()
    return pd.DataFrame({"a": [cls[i] for i in linked], "b": [cls[0]] * len(linked)})


def _verify_few(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("cls", kind="stable")
    cls = group["cls"].tolist()
    first = group_links(shingle_sets(group["text"].tolist()), np.array([c.hex() for c in group["root"]]))
    return pd.DataFrame([(cls[i], cls[j]) for i, j in enumerate(first.tolist()) if i != j], columns=["a", "b"])


def _verify_block(group: pd.DataFrame) -> pd.DataFrame:
    """A block of a bucket's members outside its largest component (left), and a block of all members (right)."""
    both = group.groupby("cls", sort=True).agg({"left": "max", "right": "max", "root": "first", "text": "first", "bucket": "first"}).reset_index()
    cls = both["cls"].tolist()
    roots = np.array([c.hex() for c in both["root"]])
    pairs = bucket_links(shingle_sets(both["text"].tolist()), both["left"].to_numpy(bool), both["right"].to_numpy(bool), roots, int(both["bucket"].iloc[0]))
    return pd.DataFrame([(cls[i], cls[j]) for i, j in pairs], columns=["a", "b"])


def _blocks(rows, shingles):
    """Blocks for so many classes and shingles."""
    return F.greatest(F.ceil(rows / GROUP_DOCS), F.ceil(shingles / GROUP_SHINGLES), F.lit(1)).cast("long")


def _star_links(members: DataFrame, leads: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of the members of each bucket with its lead. members: bucket, cls, text_key, n; leads: bucket, lead, lead_key, lead_n."""
    pairs = members.join(leads, "bucket").where("cls <> lead")
    ratio = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * THRESHOLD  # no larger similarity than the ratio of the sizes
    pairs = scratch.table(pairs.where(ratio).select("cls", "text_key", "n", "lead", "lead_key").distinct(), "stars")
    loads = pairs.groupBy("lead", "lead_key").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    loads = scratch.table(loads, "star-loads")
    often = scratch.small(loads.where("blocks > 1").select("lead", "blocks"), "hot-leads")  # one for GROUP_DOCS pairs at most
    part = F.expr("pmod(xxhash64(cls), blocks)")
    dealt = pairs.join(often, "lead", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("lead", part.alias("part"), "cls", "text_key", F.lit(False).alias("is_lead"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = loads.select("lead", every.alias("part"), F.col("lead").alias("cls"), F.col("lead_key").alias("text_key"), F.lit(True).alias("is_lead"))
    rows = dealt.unionByName(own).join(texts, "text_key")
    return rows.groupBy("lead", "part").applyInPandas(_verify_star, _LINKS)


def _open_buckets(members: DataFrame, leads: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, cls, text_key, n, root) of buckets whose members, without the lead, are not all connected."""
    named = members.where("k > 2").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    others = named.join(leads.select("bucket", "lead"), "bucket").where("cls <> lead").select("bucket", "cls", "text_key", "n", "root")
    others = scratch.table(others, "rooted")  # written, so that a wide bucket is summed up before it is moved
    ends = others.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = scratch.small(ends.where("low <> high").select("bucket"), "open-buckets")
    return scratch.table(others.join(open_, "bucket", "left_semi"), "open")


def _open_links(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links among the members of open buckets."""
    tied = scratch.small(rows.groupBy("bucket").agg(F.min("cls").alias("b")), "tied")
    clusters = connected_components(rows.join(tied, "bucket").select(F.col("cls").alias("a"), "b"), scratch)
    clusters = clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    classes = scratch.table(rows.select("cls", "text_key", "n", "root").distinct().join(clusters, "cls"), "open-classes")
    sizes = classes.groupBy("cluster").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    large = scratch.table(sizes.where("blocks > 1").select("cluster"), "large-clusters")
    few = classes.join(large, "cluster", "left_anti").select("cls", "text_key", "root", "cluster").join(texts, "text_key")
    links = few.groupBy("cluster").applyInPandas(_verify_few, _LINKS)
    if large.isEmpty():
        return links
    wide = rows.join(classes.join(large, "cluster", "left_semi").select("cls"), "cls", "left_semi")
    per = wide.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    per = per.groupBy("bucket").agg(
        F.max(F.struct("c", "root")).alias("top"), _blocks(F.sum("c"), F.sum("s")).alias("r"), F.sum("c").alias("all"), F.sum("s").alias("s")
    )
    per = per.select(
        "bucket", F.col("top.root").alias("most"), "r", _blocks(F.col("all") - F.col("top.c"), F.col("s") * (F.col("all") - F.col("top.c")) / F.col("all")).alias("l")
    )
    per = scratch.small(per, "wide-loads")  # written, so that Spark can split the join's wide buckets
    wide = scratch.table(wide.join(per, "bucket"), "wide")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.expr(f"pmod(xxhash64(cls), {n})")
    keep = ["bucket", "cls", "text_key", "root"]
    left = wide.where("root <> most").select(*keep, mine("l").alias("i"), upto("r").alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = wide.select(*keep, upto("l").alias("i"), mine("r").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    blocks = left.unionByName(right).join(texts, "text_key")
    return links.unionByName(blocks.groupBy("bucket", "i", "j").applyInPandas(_verify_block, _LINKS))


def near_duplicate_classes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (id, text_key, text) -> (documents (id, text_key, n, cls), linked classes (cls, root))."""
    sketched = scratch.table(_sketch(rows), "sketches")
    # of equal sets one row stands for all: the least digest and id, so that copies of one text don't meet in a join
    one = F.min(F.struct("text_key", F.col("id").isNull().alias("none"), "id"))
    full_sets = sketched.where("n > 0")
    banded = full_sets.groupBy("cls").agg(F.max("bands").alias("bands")).select("cls", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = scratch.table(banded.join(full, "bucket"), "shared-buckets")  # few of all rows, which hold nothing else
    classes = full_sets.groupBy("cls").agg(one.alias("one"), F.max("n").alias("n")).select("cls", F.col("one.text_key").alias("text_key"), F.col("one.id").alias("id"), "n")
    members = scratch.table(shared.join(classes, "cls"), "buckets")
    degree = members.groupBy("cls").agg(F.sum("k").alias("deg"))
    best = F.max(F.struct("deg", "cls", "text_key", "n")).alias("m")
    leads = members.join(degree, "cls").groupBy("bucket").agg(best)
    leads = scratch.table(leads.select("bucket", F.col("m.cls").alias("lead"), F.col("m.text_key").alias("lead_key"), F.col("m.n").alias("lead_n")), "leads")
    # one text for each class
    wanted = scratch.small(members.select(F.col("text_key").alias("__k"), F.col("id").alias("__i")).distinct(), "wanted")
    at = (F.col("text_key") == F.col("__k")) & F.col("id").eqNullSafe(F.col("__i"))
    texts = rows.select("text_key", "id", "text").join(wanted, at, "left_semi").dropDuplicates(["text_key", "id"]).drop("id")
    texts = scratch.table(texts, "texts")
    found = scratch.table(_star_links(members.drop("k", "id"), leads, texts, scratch), "star-links")
    roots = connected_components(found, scratch)
    open_ = _open_buckets(members, leads, roots.select(F.col("node").alias("cls"), "root"), scratch)
    if not open_.isEmpty():
        more = scratch.table(_open_links(open_, texts, scratch), "open-links")
        if not more.isEmpty():
            roots = connected_components(found.unionByName(more), scratch)
    return sketched.drop("bands"), roots.where("node <> root").select(F.col("node").alias("cls"), "root")


def _text_key(column: str):
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as one struct __row, so that no name of theirs clashes, with id and text_key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"))


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document, without its text: id, text_key (md5, binary), n_shingles, root (its component; null without words),
    component_id (the least id reachable over links) and kept (id = component_id).

    * A text without words, or null, has no shingles, links with nothing and is its own component.
    * Repeated rows and equal sets are one class and so linked. A null id is a component's
      least id only if all its ids are null; kept is false for null ids.
    * An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    found, linked = near_duplicate_classes(rows, scratch)
    classes = found.where("n > 0").groupBy("cls").agg(F.min("id").alias("least")).join(linked, "cls", "left")
    classes = scratch.table(classes.withColumn("root", F.coalesce("root", "cls")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = scratch.small(classes.join(least, "root").select("cls", "root", "component_id"), "components")
    out = found.join(roots, "cls", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select("id", "text_key", F.col("n").alias("n_shingles"), "root", "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with n_shingles, component_id and kept, as label_documents defines them; columns of these names are replaced."""
    packed = _packed(without(docs, OUT), id_col, text_col)
    labels = label_documents(docs, id_col, text_col, scratch).select("text_key", F.col("id").alias("__id"), *OUT).distinct()
    at = (packed["text_key"] == labels["text_key"]) & packed["id"].eqNullSafe(labels["__id"])
    return packed.join(labels, at, "left").select("__row.*", *OUT)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with one row of each component: that of the least id (null ids last, then by text digest).

    Rows without words link with nothing and all stay. Of repeated rows of the least id one stays.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    labels = scratch.table(label_documents(docs, id_col, text_col, scratch).where("n_shingles > 0"), "labels")
    first = labels.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("c"))
    first = scratch.small(first.select(F.col("c.id").alias("__id"), F.col("c.text_key").alias("__first")), "first")
    rows = _packed(docs, id_col, text_col)
    has_words = F.coalesce(F.col(f"__row.`{text_col}`").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    at = (F.col("text_key") == F.col("__first")) & F.col("id").eqNullSafe(F.col("__id"))
    kept = rows.where(has_words).join(first, at, "left_semi")
    if not labels.join(first, at, "left_semi").groupBy("id", "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "text_key"])
    return kept.unionByName(rows.where(~has_words)).select("__row.*")
