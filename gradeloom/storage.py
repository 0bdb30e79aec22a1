"""Cutting lineage: tables written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where none is set (tests).

    On a cluster without that setting an error is raised: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"gradeloom-{os.getpid()}")
    return named.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table written by :func:`written`; a failure is logged."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # the session may be gone at exit; the folder then goes with the cluster's own clean-up
        log.info("%s not deleted: %s", path, e)


def written(df: DataFrame, keep: bool = True) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet below the shared folder and reads it again; its lineage ends there.

    Losing an executor costs nothing that is in the table. Returns the frame and its path; with ``keep``
    the table is deleted at the end of the process, else the caller drops it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if keep:
        atexit.register(drop_table, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def task_count(spark: SparkSession, at_least: int = 1) -> int:
    """Tasks for a stage whose work is far larger than its bytes: the session's setting, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)
