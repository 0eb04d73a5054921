"""The dataflow around ingestion: units recorded once, a barrier before the merge, claims, fair order, timing, clean-up.

State lies in Parquet stores beside the data, so any step may run again after a
failure: units and claims are appended only where they are missing, and a merge
replaces the partitions it made before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ordering import global_rank, numbered
from ..sources import sinks


def record_units(units: DataFrame, store: str, keys: list[str]) -> int:
    """Units of work (such as pages) that weren't recorded yet; one delivered twice counts once."""
    return sinks.append_missing(units, store, keys)


def complete(units: DataFrame, key: str = "doc_id", unit: str = "page_idx", expected: str = "page_count") -> DataFrame:
    """Documents all of whose units are there: the number of different ones reaches what was announced."""
    done = units.groupBy(key).agg(F.count_distinct(unit).alias("units"), F.max(expected).alias("expected"))
    return done.where(F.col("units") >= F.col("expected")).select(key, "units")


def claim(ready: DataFrame, ledger: str, key: str) -> DataFrame:
    """Of what is ready, what nobody has claimed; it is claimed by being returned, once."""
    fresh = cut(sinks.unseen(ready.select(key).distinct(), ledger, key))
    sinks.append_missing(fresh.withColumn("claimed_at", F.current_timestamp()), ledger, [key])
    return fresh


def barrier(units: DataFrame, store: str, merged: str, merge: Callable[[DataFrame], DataFrame], batch: int = 0, key: str = "doc_id", unit: str = "page_idx", expected: str = "page_count") -> int:
    """One micro-batch: units are recorded, and documents that are complete by now and weren't merged are merged, each once.

    ``merge`` turns the units of the complete documents into rows. They are a partition
    named by the batch, replaced as a whole if the batch runs again before its claims are
    written. Returns the documents merged.
    """
    spark = units.sparkSession
    record_units(units, store, [key, unit])
    if not sinks.exists(spark, store):  # nothing has arrived yet
        return 0
    everything = spark.read.parquet(store)
    ready = complete(everything, key, unit, expected).select(key)
    fresh = cut(sinks.unseen(ready, f"{merged}-claims", key))
    n = fresh.count()
    if n:
        made = merge(everything.join(fresh, key, "left_semi"))
        sinks.replace_partitions(made.withColumn("batch", F.lit(batch)), merged, ["batch"])
        sinks.append_missing(fresh, f"{merged}-claims", [key])  # after the merge: a batch that failed before replaces its partition
    return n


def merge_stream(pages: DataFrame, store: str, merged: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame], **names: str):
    """A stream of units with its barrier, to the end of what has arrived."""

    def put(units: DataFrame, batch: int) -> None:
        barrier(units, store, merged, merge, batch, **names)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fair_order(units: DataFrame, by: list[str], order: list[str], name: str = "turn") -> DataFrame:
    """Units in turns: the first of every document, then the second of every document, and so on, from 0."""
    told = numbered(units, by, order, number="nth").drop("n")
    return global_rank(told, ["nth", *by], name).withColumn(name, F.col(name) - 1)


def claimable(libraries: DataFrame) -> DataFrame:
    """Libraries that may be finalised: ingested, and not started before."""
    return libraries.where((F.col("status") == "ingested") & F.col("ingested_at").isNotNull()).select("library_id")


def stage_times(runs: DataFrame, stage: str = "stage", begun: str = "begun", ended: str = "ended", units: str = "units") -> DataFrame:
    """Milliseconds a unit by stage: runs, units, mean and greatest; runs without an end or units are left out."""
    ms = (F.unix_micros(F.col(ended).cast("timestamp")) - F.unix_micros(F.col(begun).cast("timestamp"))) / 1000.0
    r = runs.where(F.col(ended).isNotNull() & F.col(begun).isNotNull() & (F.col(units) > 0)).withColumn("ms", ms / F.col(units))
    return r.groupBy(stage).agg(F.count(F.lit(1)).alias("runs"), F.sum(units).cast("bigint").alias("units"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))


def expired(rows: DataFrame, at: str, now: str | None = None, hours: int = 24) -> DataFrame:
    """Rows older than ``hours`` before ``now``."""
    limit = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
    return rows.where(F.col(at).cast("timestamp_ntz") < limit - F.expr(f"INTERVAL {hours} HOURS"))


def clean(spark: SparkSession, store: str, at: str, hours: int = 24, now: str | None = None) -> int:
    """Remove expired rows of a store; returns how many."""
    if not sinks.exists(spark, store):
        return 0
    rows = spark.read.parquet(store)
    old = expired(rows, at, now, hours).count()
    if old:
        limit = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
        cut(rows.where(F.col(at).isNull() | (F.col(at).cast("timestamp_ntz") >= limit - F.expr(f"INTERVAL {hours} HOURS")))).write.mode("overwrite").parquet(store)
    return old
