"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.lineage import cut
from ..sources import files, sinks

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str, per_trigger: int = 64, clean_source: str | None = None, reader: Callable[[DataFrame], DataFrame] = files.read):
    """Files of a landing folder to blocks in a store: each micro-batch is read as a batch would be.

    A file counts once by its path; a batch that runs again after a failure appends
    nothing twice. Backpressure is the number of files a trigger takes.
    """
    source = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true")
    if clean_source:  # files that were taken in are moved there
        source = source.option("cleanSource", "archive").option("sourceArchiveDir", clean_source)
    stream = source.load(landing)

    def put(batch: DataFrame, _: int) -> None:
        found = sinks.unseen(batch, f"{store}-ledger", "path")  # before anything is parsed
        blocks = cut(files.read_with_retries(found, reader))
        sinks.append_missing(blocks.drop("attempt"), store, ["path", "page_idx", "ordinal"])
        sinks.append_missing(blocks.select("path").distinct(), f"{store}-ledger", ["path"])

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_documents(pages: DataFrame, key: str = "doc_id", page: str = "page_idx", expected: str = "page_count", wait: str | None = "24 hours") -> DataFrame:
    """A document once, when all its pages have arrived; pages delivered twice count once.

    ``pages`` is a stream; its state is the set of seen page numbers of documents under
    way, dropped after ``wait``. A stream that waits for timeouts never runs dry, so one
    that is to end with its input (``availableNow``) takes ``wait=None``.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, done = state.get
            state.remove()
            if not done:  # one that came out complete isn't reported again
                yield pd.DataFrame({key: [k[0]], "pages": [len(seen)], "complete": [False]})
            return
        seen, done = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)
        need = None
        for f in frames:
            seen.update(int(p) for p in f[page])
            need = int(f[expected].max())
        if not done and need is not None and len(seen) >= need:
            done = True
            yield pd.DataFrame({key: [k[0]], "pages": [len(seen)], "complete": [True]})
        state.update((sorted(seen), done))
        if wait:
            state.setTimeoutDuration(int(pd.Timedelta(wait).total_seconds() * 1000))

    return pages.groupBy(key).applyInPandasWithState(run, f"{key} bigint, pages int, complete boolean", "seen array<int>, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events by window and type; ones later than the watermark are dropped by a stream."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """A user's events until a gap."""
    return events.withWatermark(at, late).groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def progress(query) -> dict:
    """What a running query says of itself."""
    last = query.lastProgress
    return {"active": query.isActive, "message": query.status["message"], "rows": last["numInputRows"] if last else 0, "batch": last["batchId"] if last else None}
