r"""Reply trees as formatted conversations.

Ancestors are found by iterative self-joins: in round k a message points 2**k messages
up, so a thread of n turns takes log2(n) rounds. Each leaf is one root-to-leaf path;
paths are ranked by their mean score within their tree and the chosen ones formatted.

Template: each turn is `<|turn|>role<|text|>text<|end|>`. In roles and texts a backslash
is put behind every `\`, `<` and `[`, so neither the template's marks nor other
templates' control strings (`</s>`, `[INST]`, `<<SYS>>`, `<|...|>`) remain whole; taking
the backslash behind these characters away restores the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPED = r"([\\<\[])"


def escape(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ESCAPED, r"$1\\")


def unescape(text):
    return F.regexp_replace(text, ESCAPED + r"\\", "$1")


def reply_paths(messages: DataFrame, scratch: Scratch, top: int | None = None) -> DataFrame:
    """messages (tree, msg, parent, score) -> (tree, leaf, rank, path_score, msg, depth), one row per message of a chosen path.

    * A parent that is null or not in the tree makes the message a root; a tree may have several.
    * A null score counts as 0; ties in the mean score rank by leaf.
    * Of rows with the same (tree, msg) the one with the least parent stays. Trees and ids may be null
      (null equals null). Messages on a cycle of parents have no root: ValueError.
    """
    one = messages.groupBy("tree", "msg").agg(F.min_by(F.struct("parent", "score"), F.struct("parent", "score")).alias("m"))
    nodes = one.select(F.struct("tree", "msg").alias("node"), F.when(F.col("m.parent").isNotNull(), F.struct("tree", F.col("m.parent").alias("msg"))).alias("up"),
                       F.coalesce(F.col("m.score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("node").alias("n2"))
    nodes = nodes.join(known, F.col("up").eqNullSafe(F.col("n2")), "left").select("node", F.col("n2").alias("up"), "score")
    # invariant: score is the sum over the node and what lies below `up`; depth counts the steps to `up`
    opened = F.col("up").isNotNull()
    nodes = scratch.table(nodes.select("node", "up", opened.cast("long").alias("depth"), "score", opened.alias("open")), "nodes")
    state = nodes
    levels: list[DataFrame] = []
    total = None
    while not state.where("open").isEmpty():
        levels.append(state.where("open").select("node", "up"))
        if total is None:
            total = state.count()
        if 2 ** (len(levels) - 1) > total:
            raise ValueError("parents form a cycle")
        above = state.select(F.col("node").alias("at"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"), F.col("open").alias("o2"))
        joined = state.where("open").join(above, F.col("up").eqNullSafe(F.col("at"))).select(
            "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score"), F.col("o2").alias("open")
        )
        state = scratch.table(joined.unionByName(state.where("not open")), f"round-{len(levels)}")
    inner = nodes.where("up is not null").select(F.col("up").alias("n2")).distinct()
    leaves = state.join(inner, F.col("node").eqNullSafe(F.col("n2")), "left_anti")
    leaves = leaves.withColumn("path_score", F.col("score") / (F.col("depth") + 1))
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("node.tree").orderBy(F.desc("path_score"), "node.msg")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    walk = ranked.select(F.col("node").alias("leaf"), "rank", "path_score", "node")
    for ups in reversed(levels):
        more = walk.join(ups.withColumnRenamed("node", "at"), F.col("node").eqNullSafe(F.col("at"))).select("leaf", "rank", "path_score", F.col("up").alias("node"))
        walk = scratch.table(walk.unionByName(more), "walk")  # else the plan doubles each round
    depths = state.select(F.col("node").alias("at"), "depth")
    return walk.join(depths, F.col("node").eqNullSafe(F.col("at"))).select(
        F.col("leaf.tree").alias("tree"), F.col("leaf.msg").alias("leaf"), "rank", "path_score", F.col("node.msg").alias("msg"), "depth"
    )


def format_trees(messages: DataFrame, scratch: Scratch | None = None, top: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """messages (tree, msg, parent, role, text, score) -> (tree, leaf, rank, path_score, formatted, loss_spans).

    loss_spans: array of (start, end), code points of `formatted`, one for each text of loss_role, in order.
    Null roles and texts are empty. An empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(messages.sparkSession)
    rows = messages.select("tree", "msg", "parent", "role", "text", "score")
    paths = reply_paths(rows.select("tree", "msg", "parent", "score"), scratch, top)
    body = rows.groupBy(F.col("tree").alias("t2"), F.col("msg").alias("m2")).agg(
        F.min_by(F.struct("role", "text"), F.struct("parent", "score", "role", "text")).alias("b")
    )
    turns = paths.join(body, F.col("tree").eqNullSafe(F.col("t2")) & F.col("msg").eqNullSafe(F.col("m2")))
    head = F.concat(F.lit(TURN), escape(F.col("b.role")), F.lit(TEXT))
    turns = turns.select("tree", "leaf", "rank", "path_score", "depth", head.alias("head"), escape(F.col("b.text")).alias("body"), (F.coalesce("b.role", F.lit("")) == loss_role).alias("loss"))
    size = F.length("head") + F.length("body") + len(END)
    before = W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("loss"), F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    done = turns.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"),
        F.first("path_score").alias("path_score"),
        F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("text")))).alias("parts"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )
    return done.select("tree", "leaf", "rank", "path_score", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted, loss_spans -> also turns (array of role, text) and loss_text, both read from the output and unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    turn = lambda p, i: unescape(F.regexp_extract(p, r"(?s)^<\|turn\|>(.*?)<\|text\|>(.*)$", i))
    turns = F.transform(pieces, lambda p: F.struct(turn(p, 1).alias("role"), turn(p, 2).alias("text")))
    spans = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(spans, ""))


def messages_of(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees of one branch: each row replies to the one before, by turn, then role and text."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("k", at)
    return rows.select(
        F.col("conv_id").alias("tree"), F.col("k").alias("msg"), F.when(F.col("k") > 1, F.col("k") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score")
    )
