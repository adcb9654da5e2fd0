"""Tables that a plan writes once and reads many times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; it goes when the application ends.

    Where that is unset, a temporary folder is made if all tasks run in the driver's process; on a
    cluster, whose executors could not see it, this raises.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        _roots[app] = f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='tidemark-')}/stored-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in this application's."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: what reads it neither computes it anew nor depends on lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway is gone at exit: the cluster's own cleaning remains
        pass
