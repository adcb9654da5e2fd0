"""A training-corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is to be written and
read again before the next stage is called; all but the last return the columns of docs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, quality, sharding
from tidemark.llm.common import Scratch, read

SHARD_BYTES = 64 << 20
#: SQL cannot express the mixing stage's dynamic program; tests/llm holds the stages against brute force.
ORACLE_SQL = None

_open: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    """A scratch for the stage that begins; those of earlier stages go, as their results have been written."""
    while _open:
        _open.pop().release()
    _open.append(Scratch(spark))
    return _open[-1]


def _aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list]:
    """docs with columns named like one in use under free names, and the columns that name them back, in order."""
    clash = {n.lower() for n in used}
    free = (n for n in map("__aside{}".format, itertools.count()) if n not in docs.columns)
    names = [(c, next(free) if c.lower() in clash else c) for c in docs.columns]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names]), [F.col(f"`{n}`").alias(c) for c, n in names]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines; n_chars follows the text.

    A null or empty text fails, as it has too few words; null ids and other nulls stay as they are. Rows are
    judged alone, so ties and repeated rows are alike. An empty table gives an empty one. Columns
    named like the rules' figures keep their values.
    """
    kind = next((f.dataType for f in docs.schema if f.name == "n_chars"), None)
    docs, back = _aside(docs, [c for c, _ in quality.STATS])
    changed = quality.clean_documents(docs).where("kept").withColumn("text", F.col("cleaned"))
    if kind is not None:
        changed = changed.withColumn("n_chars", F.when(F.col("n_bad_lines") > 0, F.length("cleaned").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id's (null ids last, then the least text digest).

    Null texts and texts without words are in no group and stay. Of repeated rows of the chosen
    one, one stays. An empty table gives an empty one; no column name clashes.
    """
    return minhash.drop_near_duplicates(docs, scratch=_scratch(spark))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts are clean and stay; repeated rows are judged alike; an empty table on either
    side removes nothing. Columns named like the operator's figures keep their values.
    """
    docs, back = _aside(docs, [*decontaminate.OUT, "__doc", "__n"])
    judged = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), scratch=_scratch(spark))
    return judged.where("not contaminated").select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; documents without words take nothing and go.

    Null is a source of its own. Documents of a source and length are chosen by a seeded hash of id and text; rows
    equal in both are alike, whichever is taken. An empty table gives an empty one. Columns
    named like the operator's figures keep their values.
    """
    docs, back = _aside(docs, mixing.OUT)
    mixed = mixing.mix(docs, scratch=_scratch(spark)).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size")))
    return mixed.select(F.struct(*back).alias("row"), times).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard.

    Null ids and texts count as empty; rows equal in id and text beyond the limit are cut into an overflow
    chain; an empty table gives no rows. Columns named like the shard's are replaced, as the stage returns those.
    """
    return sharding.assign_shards(docs, SHARD_BYTES, scratch=_scratch(spark))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    kept = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
