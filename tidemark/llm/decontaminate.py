"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Index: postings (term, document, position) of the documents' words, for the terms that
test windows hold, stored once. A window of 13 test words is looked up from its rarest terms:
the postings of the rarest one, moved back by the term's offset, are candidate starts; they
are intersected with the moved postings of the next rarest term; what is left is
compared with the document's words at that start. Rarity is counted over all
documents. Where postings meet windows the key holds the term and a part of the documents,
later keys hold the document and the start, so a frequent term or a passage that many
documents share does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, without

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Terms of a window whose postings are intersected before the words are compared.
RAREST = 2
#: Postings of one term, or hits of one window, that a join key holds on average; more frequent ones are dealt out.
KEY_ROWS = 1 << 20
OUT = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def words(text):
    """Array of words: A-Z lower-cased, split at ASCII characters that are no letter or digit; null: none."""
    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), AZ, AZ.lower())
    return F.filter(F.split(clean, SEPARATOR), lambda w: w != "")


def windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, win array<string>): each item's windows of `size` words; an item with fewer words, but some, is one."""
    w = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - F.lit(size), F.lit(0))
    return w.select("item", F.explode(F.sequence(F.lit(0), last)).alias("i"), "w").select(
        "item", F.expr(f"slice(w, i + 1, {size})").alias("win")
    )


def _salts(most: int | None) -> int:
    """Parts that the rows of one key are dealt into, where the most frequent key has `most` rows."""
    return max(1, -(-(most or 0) // KEY_ROWS))


def find_windows(tokens: DataFrame, wins: DataFrame, scratch: Scratch) -> DataFrame:
    """Exact occurrences (doc, start, len, win_id) of the distinct windows `wins` (win_id, win) in tokens (doc, w).

    The texts are cut into words once, for the postings of all test terms; what follows
    reads the stored postings. They are joined to windows by term and a part of the
    documents, so a term in every document is dealt out, too.
    """
    # terms by their 64-bit hash: should two be alike, there are more candidates, which the words then decide
    hashed = F.transform("win", lambda term: F.xxhash64(term))
    terms = scratch.small(wins.select(F.explode(hashed).alias("term")).distinct(), "terms")
    postings = tokens.select("doc", F.posexplode("w").alias("pos", "word")).select(F.xxhash64("word").alias("term"), "doc", "pos")
    postings = scratch.table(postings.join(terms, "term", "left_semi"), "postings")
    counts = scratch.table(postings.groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "term-counts")
    # terms that no document has stop their windows here: nothing can match them
    spread = wins.select("win_id", F.size("win").alias("len"), F.posexplode(hashed).alias("off", "term"))
    ranked = spread.join(counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    by_rarity = W.partitionBy("win_id").orderBy("cf", "term", "off")
    ranked = ranked.withColumn("rk", F.row_number().over(by_rarity)).withColumn("least", F.min("cf").over(W.partitionBy("win_id")))
    anchors = scratch.table(ranked.where(f"rk <= {RAREST} and least > 0").select("win_id", "len", "off", "term", "rk", "cf"), "anchors")

    looked_up = scratch.small(anchors.select("term").distinct(), "anchor-terms")
    salts = _salts(anchors.agg(F.max("cf")).first()[0])
    index = postings.join(looked_up, "term", "left_semi").withColumn("part", F.expr(f"pmod(xxhash64(doc), {salts})"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    dealt = scratch.small(anchors.withColumn("part", every).drop("cf"), "dealt-anchors")
    start = F.col("pos") - F.col("off")
    moved = index.join(dealt, ["term", "part"]).where(start >= 0).select("doc", start.alias("start"), "win_id", "len", "rk")
    # the intersection of the moved lists: starts that are in the lists of all ranks
    ranks = F.count_distinct("rk") if RAREST > 2 else F.max("rk") - F.min("rk") + 1
    starts = moved.groupBy("doc", "start", "win_id", "len").agg(ranks.alias("ranks"))
    return scratch.table(starts.where(F.col("ranks") == F.least("len", F.lit(RAREST))).drop("ranks"), "starts")


def match_phrases(
    texts: DataFrame,
    items: DataFrame,
    size: int,
    scratch: Scratch,
    item_col: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(hits (doc, n_words, start, len, win_id), members (win_id, item)); texts: doc, text (repeated rows are fine).

    win_id is the SHA-256 of the window's words, which hold no blank, so a candidate is
    confirmed by the digest of the words at its start: no join by window, however often it occurs.
    """
    name = lambda win: F.unhex(F.sha2(F.array_join(win, " ").cast("binary"), 256))
    all_wins = windows(items, item_col, item_text, size).distinct()
    members = scratch.table(all_wins.withColumn("win_id", name("win")), "windows")
    distinct = members.select("win_id", "win").distinct()
    tokens = lambda rows: rows.select("doc", words(F.col("text")).alias("w"))
    starts = find_windows(tokens(texts), distinct, scratch)
    candidates = scratch.small(starts.select("doc").distinct(), "candidates")
    # whole texts are moved, not their words, and where the list is small only those of candidates
    chosen = texts.join(candidates, "doc", "left_semi").dropDuplicates(["doc"])
    found = (
        starts.join(tokens(chosen), "doc")
        .where(name(F.expr("slice(w, start + 1, len)")) == F.col("win_id"))
        .select("doc", F.size("w").cast("long").alias("n_words"), "start", "len", "win_id")
    )
    return scratch.table(found, "hits"), members.select("win_id", "item")


def near_matches(hits_a: DataFrame, hits_b: DataFrame, slop: int) -> DataFrame:
    """Proximity: pairs of hits of one document whose gap is at most `slop` words, in either order.

    hits: doc, start, len (as match_phrases returns them). Starts are cut into blocks of
    the reach, so a join key holds the document and a block, never the whole document.
    """
    reach = hits_a.select(F.max("len")).first()[0] or 1
    reach = max(reach, hits_b.select(F.max("len")).first()[0] or 1) + slop
    a = hits_a.select("doc", F.col("start").alias("a"), F.col("len").alias("a_len"))
    a = a.withColumn("block", F.explode(F.sequence(F.floor((F.col("a") - reach) / reach), F.floor((F.col("a") + reach) / reach))))
    b = hits_b.select("doc", F.col("start").alias("b"), F.col("len").alias("b_len")).withColumn("block", F.floor(F.col("b") / reach))
    gap = F.greatest(F.col("b") - F.col("a") - F.col("a_len"), F.col("a") - F.col("b") - F.col("b_len"), F.lit(0))
    return a.join(b, ["doc", "block"]).where(gap <= slop).select("doc", "a", "a_len", "b", "b_len", gap.alias("gap"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    share: int = 20,
    scratch: Scratch | None = None,
) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a test window), n_items and items (sorted ids, as
    strings, of items with an occurring window) and contaminated (n_hit > 0 and share * n_hit >= n_words).

    * Null texts have no words: no hit, not contaminated; items without words match nothing.
    * Documents are told apart by their text, so repeated rows and ids get equal results;
      null item ids are kept out of `items` but their windows hit.
    * Input columns named like an output are replaced. Empty tables on either side are fine.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = without(docs, [*OUT, "__doc", "__n"]).withColumn("__doc", F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    counted = rows.withColumn("n_words", F.size(words(F.col(text_col))).cast("long"))  # before the join, so a text that is not asked for is not moved
    texts = rows.select(F.col("__doc").alias("doc"), F.col(text_col).cast("string").alias("text"))
    hits, members = match_phrases(texts, items, size, scratch, item_col, item_text)
    order = W.partitionBy("doc").orderBy("start", "len")
    end = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(W.unboundedPreceding, -1))
    covered = hits.select("doc", "n_words", "start", "len", F.coalesce(end, F.lit(0)).alias("end")).withColumn(
        "new", F.greatest(F.col("start") + F.col("len") - F.greatest("start", "end"), F.lit(0))
    )
    covered = covered.groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"), F.max("n_words").alias("__n"))
    salts = _salts(hits.groupBy("win_id").count().agg(F.max("count")).first()[0])
    dealt = members.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    seen = hits.select("doc", "win_id").distinct().withColumn("part", F.expr(f"pmod(xxhash64(doc), {salts})"))
    which = seen.join(dealt, ["win_id", "part"]).select("doc", F.col("item").cast("string").alias("item")).distinct()
    which = which.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))  # no more than there are items
    found = covered.join(which, "doc", "left").withColumnRenamed("doc", "__doc")
    found = scratch.table(found, "found")
    return (
        counted.join(found, "__doc", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.coalesce("__n", F.lit(0))))
        .drop("__doc", "__n")
    )
