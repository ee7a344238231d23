"""Staging: cut lineage by writing a table into the folder that all executors share.

A staged table survives the loss of executors, is compressed (a checkpoint is not) and can be read
column by column.  The folder is the one that the cluster names in spark.checkpoint.dir; only a session
on one machine (tests, interactive use) may leave it unset and gets a temporary one, which goes with
the process.  What a session staged is below one folder of its own: clear() deletes it, and rounds of
an iteration release() what they have replaced.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of the session's application below spark.checkpoint.dir, or a temporary one on a single machine.

    RuntimeError on a cluster that names no folder: one of a machine's own would hold a part of each table.
    """
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/tidemark-{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if app not in _own:
        where = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        _own[app] = "file://" + where
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all that the session's application has staged; tables that read it can no longer be read."""
    _delete(spark, shared_dir(spark))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once (Parquet, zstd) and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that stage() returned and that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        _delete(df.sparkSession, path)


def merged(df: DataFrame) -> DataFrame:
    """df for joins that shuffle it, whatever its size is thought to be.

    Spark takes a staged table for as large as its compressed files and what Python makes for as many
    rows as go in; by that, the driver would collect and broadcast what is many times as large.
    """
    return df.hint("merge")


def forget(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted now, not when the driver happens to collect its garbage."""
    for _ in range(2):  # what the first one finds still holds a part of the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, before work that is heavy for its bytes.

    A scan of few, small files has few partitions and would leave cores idle; a scan that is split
    enough, as any large one is, stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
