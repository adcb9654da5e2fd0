"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source whose target is e whole
epochs and a rest takes each document e times; the rest is filled by lengths: most of it
in proportion to the length counts, the remaining budget by a bounded-knapsack dynamic
program over the length counts that are left. Documents of a length are then taken in
the order of a seeded hash, as many as the length counts say.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Scratch, without

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: The dynamic program's budget: sums up to this many words are fitted exactly.
DP_BUDGET = 1 << 16
#: Sums that are listed before the program is used instead.
STATES = 1 << 20
#: Documents of one source and length are ranked in blocks of about this many.
BLOCK = 256
OUT = ["size", "source_size", "target", "taken"]


def word_count(text):
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size), one row per source -> also target, a double.

    Weights go to the sources by code point, null last, and repeat. The sum of all sizes
    is shared by weight; a target stops at max_epochs times its source's size, and the
    excess goes to the others by weight. So a target is level * weight, or the cap where
    that is lower; capped are the sources of lowest cap/weight, and the level follows
    from the sums over the others. One row per source is sorted here, not documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
    )
    # a source is capped if, with those before it capped, its share of the rest is over its cap
    share = (F.col("total") - F.col("cap_before")).cast("double") * F.col("w") / (F.col("all_w") - F.col("w_before"))
    ranked = ranked.withColumn("capped", share > F.col("cap"))
    ranked = ranked.withColumn("cap_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
    ranked = ranked.withColumn("w_sum", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    level = (F.col("total") - F.col("cap_sum")).cast("double") * F.col("w") / F.col("w_sum")
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is as near below budget as can be.

    reached[s] holds the first length with which the sum s came about, used[s] how many
    of that length it took; going back over them gives the counts.
    """
    reached = np.full(budget + 1, -1, np.int32)
    used = np.zeros(budget + 1, np.int64)
    able = np.zeros(budget + 1, bool)
    able[0] = True
    for i, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist())):
        if n > budget or c <= 0:
            continue
        step, left = n, min(c, budget // n)
        fresh_used = np.zeros(budget + 1, np.int64)
        base, take = able.copy(), 1
        while left > 0:  # counts as powers of two: every count up to c is a sum of them
            take = min(take, left)
            shift = take * step
            new = np.zeros(budget + 1, bool)
            new[shift:] = base[: budget + 1 - shift]
            new &= ~base
            at = np.flatnonzero(new)
            fresh_used[at] = fresh_used[at - shift] + take
            base[at] = True
            left -= take
            take *= 2
        at = np.flatnonzero(base & ~able)
        reached[at], used[at], able = i, fresh_used[at], base
        if able[budget]:
            break
    s = int(np.flatnonzero(able)[-1])
    out = np.zeros(len(lengths), np.int64)
    while s:
        i = int(reached[s])
        out[i] += used[s]
        s -= int(used[s] * lengths[i])
    return out


def _powers_of_two(count: int) -> list[int]:
    """Parts whose subsets have every sum up to count."""
    parts, take = [], 1
    while count > 0:
        parts.append(min(take, count))
        count -= parts[-1]
        take *= 2
    return parts


def sparse_fit(lengths: np.ndarray, counts: np.ndarray, budget: int, states: int = STATES) -> np.ndarray | None:
    """Counts whose sum is as near below budget as any subset's; None if that takes more than `states` sums to tell.

    The sums that subsets reach are kept as sorted arrays, one for each part added, so
    going back over them gives the counts. It doesn't matter how long the lengths are.
    """
    steps, sums, held = [], np.zeros(1, np.int64), 1
    for i in np.argsort(-lengths, kind="stable").tolist():
        for part in _powers_of_two(min(int(counts[i]), budget // int(lengths[i]))):
            more = sums + part * int(lengths[i])
            steps.append((i, part, sums))
            sums = np.union1d(sums, more[more <= budget])
            held += len(sums)
            if held > states:
                return None
        if sums[-1] == budget:
            break
    at, out = int(sums[-1]), np.zeros(len(lengths), np.int64)
    for i, part, before in reversed(steps):
        j = int(np.searchsorted(before, at))
        if j < len(before) and before[j] == at:
            continue
        out[i] += part
        at -= part * int(lengths[i])
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """Counts to take of each length (different positive lengths, at most counts), their sum at most budget and near it.

    If subsets reach few different sums, these are all listed and the nearest is taken. Otherwise
    most of the budget is filled in proportion, so that all lengths are drawn from alike, then by the longest,
    and the dynamic program fits the rest. The sum is then short of the budget by less than
    the shortest length that is not used up.
    """
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    few = sparse_fit(lengths, counts, budget)
    if few is not None:
        return few
    take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    rest, left = budget - int((lengths * take).sum()), counts - take
    order = np.argsort(-lengths, kind="stable")
    for keep in (dp_budget // 2, 0):  # down to the program's budget by the longest lengths; all of it, if those are longer
        for i in order:
            if rest <= dp_budget:
                break
            more = min(int(left[i]), max(0, rest - keep) // int(lengths[i]))
            take[i] += more
            left[i] -= more
            rest -= more * int(lengths[i])
    # longest first, so that the short ones fill what is left
    take[order] += knapsack(lengths[order], left[order], int(min(rest, dp_budget)))
    return take


def _fit_source(cells: pd.DataFrame) -> pd.DataFrame:
    """cells: src, len, n, budget of one source: one row for each different length."""
    cells = cells.sort_values("len", kind="stable")
    lengths, counts = cells["len"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    return pd.DataFrame({"src": cells["src"].to_numpy(), "len": lengths, "n": counts, "extra": fit(lengths, counts, int(cells["budget"].iloc[0]))})


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    scratch: Scratch | None = None,
    with_text: bool = True,
) -> DataFrame:
    """docs (without its text, if not with_text) with size (words), source_size, target and taken (words the mix
    takes, repeats counted).

    taken is size times the document's repeats: whole epochs of its source, and one more
    for the chosen ones, so never over max_epochs times size. A source's taken words are
    at most its target, and short of it by less than its shortest length of which the last epoch leaves
    documents out (`fit`); where subsets of its lengths reach few sums, none comes nearer.
    Words are counted once and stored with the chosen hash; texts are read again only with_text.

    * Null texts and texts without words have size 0 and take nothing. Null is a source of its own, the last.
    * Documents of a source and length are chosen by xxhash64(seed, id, text), so a rerun or another
      partitioning chooses the same; rows equal in both are alike, whichever is taken.
    * An empty table gives no rows. Input columns named like an output are replaced.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = without(docs, OUT)
    kept = [F.col(f"`{c}`") for c in rows.columns if with_text or c != text_col]
    # a null source gets a mark that sorts with nothing else: the struct keeps null and any text apart
    source = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    pick = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    # the input's columns travel in one struct, so that no name of theirs clashes
    rows = rows.select(F.struct(*kept).alias("__row"), source.alias("__src"), word_count(F.col(text_col)).alias("size"), pick.alias("__pick"))
    narrow = scratch.table(rows.drop("__row") if with_text else rows, "sizes")
    rows, whole = narrow, rows if with_text else narrow
    cells = scratch.table(rows.groupBy("__src", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = cells.groupBy("__src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    named = sizes.select("__src", F.when(F.col("__src") != "n", F.expr("substring(__src, 2)")).alias("source"), "source_size")
    goals = targets(named.drop("__src"), weights, max_epochs).withColumn(
        "__src", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    )
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    goals = goals.withColumn("budget", F.greatest(F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"), F.lit(0)).cast("long"))
    goals = scratch.small(goals.drop("source"), "targets")
    room = F.when(F.col("epochs") < max_epochs, F.col("budget")).otherwise(0)
    fitted = (
        cells.where("size > 0")
        .join(goals, "__src")
        .select(F.col("__src").alias("src"), F.col("size").alias("len"), "n", room.alias("budget"))
        .groupBy("src")
        .applyInPandas(_fit_source, "src string, len long, n long, extra long")
    )
    fitted = scratch.table(fitted.select(F.col("src").alias("__src"), F.col("len").alias("size"), "n", "extra"), "fitted")

    # large groups of one length: count blocks of the hash, so that only the block where the count ends is ranked
    blocks = F.when(F.col("n") > 2 * BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1)
    some = fitted.where("extra > 0 and extra < n").withColumn("blocks", blocks.cast("long")).select("__src", "size", "extra", "blocks")
    large = scratch.small(some.where("blocks > 1"), "large-groups")
    key = ["__src", "size"]
    in_large = rows.select(*key, "__pick").join(large, key).groupBy(*key, "extra", "blocks", F.expr("pmod(__pick, blocks)").alias("__block"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(*key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = in_large.agg(F.count(F.lit(1)).alias("c")).withColumn("before", before)
    ends = ends.where("before < extra and before + c >= extra").select(*key, F.col("__block").alias("cut"), (F.col("extra") - F.col("before")).alias("in_cut"))
    cuts = some.join(ends, key, "left").select(
        *key, "blocks", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"), F.coalesce("in_cut", "extra").alias("in_cut")
    )
    cuts = scratch.small(cuts, "cuts")
    # rank only the rows of cut blocks, by ids alone; a row's copies (equal id and text) are ranked as one run
    picks = rows.select(*key, "__pick").join(cuts, key).where(F.expr("pmod(__pick, blocks)") == F.col("cut"))
    runs = picks.groupBy(*key, "in_cut", "__pick").agg(F.count(F.lit(1)).alias("c"))
    upto = F.coalesce(F.sum("c").over(W.partitionBy(*key).orderBy("__pick").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = runs.withColumn("before", upto).where("before < in_cut and before + c >= in_cut")
    last = last.select(*key, F.col("__pick").alias("last_pick"), (F.col("in_cut") - F.col("before")).alias("in_run"), F.col("c").alias("run"))
    last = scratch.table(last, "last")
    plan = scratch.small(fitted.join(cuts, key, "left").join(last, key, "left"), "plan")

    block = F.expr("pmod(__pick, blocks)")
    inside = (block < F.col("cut")) | ((block == F.col("cut")) & (F.col("__pick") < F.col("last_pick")))
    tie = (block == F.col("cut")) & (F.col("__pick") == F.col("last_pick"))
    out = whole.join(plan, key, "left").join(goals, "__src", "left")
    one = F.when(F.coalesce("extra", F.lit(0)) == 0, F.lit(0)).when(F.col("extra") >= F.col("n"), F.lit(1)).when(inside, F.lit(1))
    # the run in which the count ends: all of it, unless copies are cut apart
    out = out.withColumn("__one", one.when(tie & (F.col("in_run") >= F.col("run")), F.lit(1)).when(tie, F.lit(-1)).otherwise(F.lit(0)))
    finish = lambda df, extra: df.select(
        "__row.*", "size", "source_size", "target", (F.col("size") * (F.coalesce("epochs", F.lit(0)) + extra)).cast("long").alias("taken")
    )
    if last.where("in_run < run").isEmpty():
        return finish(out, F.col("__one"))
    # copies of one row of which some are taken: numbered; they are alike, so any order is right
    ranked = out.where("__one = -1").withColumn("__k", F.row_number().over(W.partitionBy(*key, "__pick").orderBy("__pick")))
    return finish(out.where("__one >= 0"), F.col("__one")).unionByName(
        finish(ranked, F.when(F.col("__k") <= F.col("in_run"), 1).otherwise(0))
    )
