"""Continuous ingestion: versions of documents arrive in any order, and the index follows the latest of each path."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.passages import Embedder, chunk
from ..operators.synchronize import synchronize
from ..session import written
from ..sources.buckets import BucketStore

#: Columns of a stream of documents; a row of a deletion has no text.
DOCUMENT = "source_path string, version long, content_type string, text string, deleted boolean"
#: The state store that keeps versions and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestVersion(StatefulProcessor):
    """Passes a path's row on if its version is later than all before it.

    The version of a deletion stays as a tombstone, so that an older version
    which arrives late does not bring the path back; a timer clears it after
    ``retention`` seconds.  Of rows of one version a deletion counts before
    others, and then the greater text, whatever order they come in.
    """

    def __init__(self, retention: float) -> None:
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "version long, deleted boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            for row in frame.itertuples(index=False):
                rank = (int(row.version), bool(row.deleted), row.text or "", row.content_type or "")
                if best is None or rank > best[0]:
                    best = (rank, row)
        (version, deleted, _, _), row = best
        if self.latest.exists() and self.latest.get()[0] >= version:
            return
        self.latest.update((version, deleted))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if deleted:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.retention))
        yield pd.DataFrame({"source_path": [key[0]], "version": [version], "content_type": [row.content_type], "text": [None if deleted else row.text], "deleted": [deleted]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[1]:
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_versions(stream: DataFrame, retention: float = 7 * 86_400) -> DataFrame:
    """Of a stream of ``DOCUMENT`` rows those that are later than all before of their path; null paths are left out.

    Needs ``spark.sql.streaming.stateStore.providerClass`` to be ``STATE_STORE``.
    """
    rows = stream.select("source_path", F.col("version").cast("long").alias("version"), "content_type", "text", F.coalesce("deleted", F.lit(False)).alias("deleted")).filter("source_path is not null and version is not null")
    return rows.groupBy("source_path").transformWithStateInPandas(statefulProcessor=LatestVersion(retention), outputStructType=DOCUMENT, outputMode="Update", timeMode="ProcessingTime")


def apply(store: BucketStore, batch: DataFrame, number: int, bundle: str, stream: str, limit: int = 1000, embedder: Embedder | None = None, model: str = "word-hash") -> None:
    """Put the passages of a batch of latest versions in place of those of their paths, once for each batch number."""
    if store.current().batches.get(stream, -1) >= number:
        return
    rows = written(batch, "batch")  # a stateful batch may be worked out once only
    if not rows.limit(1).count():
        return
    passages = chunk(rows.filter("not deleted").select("source_path", "content_type", "text"), limit)
    snapshot = passages.dropDuplicates(["chunk_id"]).withColumn("bundle_id", F.lit(bundle)).withColumn("input", F.col("content"))
    synchronize(store, snapshot, bundle, embedder, model, batch=(stream, number), only_paths=rows.select("source_path"))


def ingest(stream: DataFrame, store: BucketStore, bundle: str, checkpoint: str, name: str = "ingest", retention: float = 7 * 86_400, **trigger) -> StreamingQuery:
    """Keep ``bundle`` in ``store`` at the latest versions of a stream of ``DOCUMENT`` rows.

    A batch that is replayed, after a driver was lost behind its commit, changes
    nothing: the store's entry says which batch of ``name`` came last.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = latest_versions(stream, retention).writeStream.outputMode("update").foreachBatch(lambda batch, number: apply(store, batch, number, bundle, name))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"once": True})).start()
