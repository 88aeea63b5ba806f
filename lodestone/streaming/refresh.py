"""Continuous refresh: documents that arrive as a stream update an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.passages import chunk, embed
from ..operators.sync import refuse_conflicts
from ..sources.generations import GenerationStore


def apply_batch(store: GenerationStore, documents: DataFrame, model: str = "word-hash", limit: int = 1000) -> str | None:
    """Chunk and embed a batch of documents and publish them in place of their older passages.

    A path with several texts in one batch is refused: nothing says which is the
    later one.  Streams of numbered versions are for ``ingest``.
    """
    if documents.isEmpty():
        return None
    from pyspark.sql import functions as F

    refuse_conflicts(documents, "source_path", "text")
    documents = documents.dropDuplicates(["source_path"])
    chunks = chunk(documents, limit)
    vectors = embed(chunks, "chunk_id", "content").withColumn("model", F.lit(model))
    if store.current() is None:
        return store.publish(chunks, vectors)
    stale = store.read("chunks").join(documents.select("source_path"), "source_path", "left_semi").select("chunk_id")
    return store.replace(chunks, vectors, stale.join(chunks.select("chunk_id"), "chunk_id", "left_anti"))


def refresh(stream: DataFrame, store: GenerationStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``apply_batch`` on each micro-batch of a stream of documents (source_path, content_type, text)."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
