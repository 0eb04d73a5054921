"""Cutting lineage on shared storage, spreading narrow inputs, bounded collects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure the context has a checkpoint folder.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only where that is unset
    and the master is this one machine is a folder of its own made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hold Arrow batches to ``rows``, so that a batch of very long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Round-robin a scan of fewer partitions than there are task slots; wider inputs pass unchanged.

    Only scans and what is narrow above them are looked at, as their partitions are known
    without a job; what has been shuffled is spread by its shuffle. Meant for what goes
    to Python, so Arrow batches are bounded as well.
    """
    bound_batches(df.sparkSession)
    least = least or df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    return df if execution.toRdd().getNumPartitions() >= least else df.repartition(least)
