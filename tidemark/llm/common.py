"""What the operators of this subpackage share: table reading, scratch tables, patterns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for the operators that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset, a temporary folder is made if all tasks run in the driver's
    process; on a cluster, whose executors could not see it, this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidemark-")
    return f"file://{_own_dirs[app]}"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    They survive lost executors, as they are files, and are read again by any of
    them. `release` deletes them; it runs when the application ends at the latest.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.release)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read again."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, df: DataFrame, name: str, limit: int = 16 << 20) -> DataFrame:
        """df, written and read again, to be broadcast only if its rows take at most `limit` bytes in memory.

        Files over the limit are not counted; of others the rows and the bytes of their
        variable-length values are.
        """
        path = self.path(name)
        df.write.parquet(path)
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        out = self.spark.read.schema(df.schema).parquet(path)
        return F.broadcast(out) if size <= limit and memory_of(out) <= limit else out

    def drop(self, df_path: str) -> None:
        """Deletes one folder of this scratch."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df_path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def release(self) -> None:
        """Deletes every table; results that read them must have been written by then."""
        atexit.unregister(self.release)
        try:
            self.drop(self.root)
        except Exception:  # noqa: BLE001  the gateway is gone at exit: the cluster's own cleaning remains
            pass


def memory_of(df: DataFrame) -> int:
    """Bytes that df's rows take in a hashed relation: fixed parts, and the lengths of what varies."""
    varies = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    lengths = [F.octet_length(F.col(f"`{n}`").cast("string")) for n in varies]
    body = sum((F.coalesce(n, F.lit(0)) for n in lengths), F.lit(0).cast("long"))
    rows, held = df.agg(F.count(F.lit(1)), F.sum(body)).first()
    return rows * (32 + 16 * len(df.columns)) + (held or 0)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns an operator is about to add."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
