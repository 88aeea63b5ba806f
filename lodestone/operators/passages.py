"""Passages of documents: chunking, ids, embedding input and the default embedder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions.text import chunk_id
from ..functions.vectors import unit_rows

SCHEMA = (
    "source_path string, line_start int, line_end int, chunk_type string, content string, heading_path array<string>, "
    "parent_line int, heading_level int, code_language string, table_header string, symbol string, parent_symbol string, truncated boolean"
)
#: Rows that are Python objects at once, and passages that are handed on at once.
SLICE_ROWS, OUT_ROWS = 250, 2_000
#: Chunker by content type; ``register`` adds to it.
CHUNKERS: dict[str, Callable[..., Iterator[chunking.Passage]]] = {
    "text": chunking.paragraphs,
    "lines": chunking.line_blocks,
    "sentences": lambda text, limit: chunking.paragraphs(text, limit, by_sentence=True),
    "markdown": chunking.markdown,
    "typescript": chunking.typescript,
}


def register(content_type: str, chunker: Callable[[str, int], Iterator[chunking.Passage]]) -> None:
    """Make a chunker known under a content type, in any case."""
    CHUNKERS[content_type.lower()] = chunker


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few rows at once are Python objects, however many Spark hands over."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def chunk(documents: DataFrame, limit: int = 1000, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Passages of documents (source_path, content_type, text), with their ids and that of the heading above them.

    Passages of the types ``leave_out`` (heading, code, table and so on) are not
    returned; where headings are left out no passage has a parent.  One document is one row of work and nothing is shuffled.  Documents of a
    content type without a chunker give none; ``unsupported`` lists them.
    """
    known = dict(CHUNKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number = pa.string(), pa.int32()
        kinds = pa.schema({
            "source_path": text, "line_start": number, "line_end": number, "chunk_type": text, "content": text, "heading_path": pa.list_(text), "parent_line": number,
            "heading_level": number, "code_language": text, "table_header": text, "symbol": text, "parent_symbol": text, "truncated": pa.bool_(),
        })
        for batch in slices(batches):
            rows = []
            for path, kind, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                above: list[tuple[int, int]] = []  # levels and lines of the headings around
                for start, end, what, content, more in known[kind](body or "", limit):
                    level = more.get("heading_level")
                    above = [x for x in above if level is None or x[0] < level]
                    rows.append({"source_path": path, "line_start": start, "line_end": end, "chunk_type": what, "content": content, "parent_line": above[-1][1] if above else None, **more})
                    if level is not None:
                        above.append((level, start))
                if len(rows) > OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, kinds)

    chosen = documents.select("source_path", F.lower("content_type").alias("content_type"), "text").filter(F.col("content_type").isin(*known))
    parts = chosen.mapInArrow(run, SCHEMA)
    if leave_out:
        parts = parts.filter(~F.col("chunk_type").isin(*leave_out))
    above = F.try_element_at("heading_path", F.when(F.col("chunk_type") == "heading", -2).otherwise(-1))
    parent = F.when(F.col("parent_line").isNotNull(), chunk_id(F.col("source_path"), F.col("parent_line"), F.col("parent_line"), F.lit("heading"), above))
    if "heading" in leave_out:
        parent = F.lit(None).cast("string")  # passages name no parent that is not there
    return parts.withColumns({"chunk_id": chunk_id(*map(F.col, ("source_path", "line_start", "line_end", "chunk_type", "content"))), "parent_id": parent})


def unsupported(documents: DataFrame) -> DataFrame:
    """Documents whose content type has no chunker."""
    return documents.filter(~F.lower("content_type").isin(*CHUNKERS))


def split_to_fit(text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """Cut a text at white space near the middle until each part has at most ``limit`` tokens; nothing is lost.

    A part without white space is cut in the middle.
    """
    if count(text) <= limit or len(text) < 2:
        return [text]
    middle = len(text) // 2
    gaps = [m.end() for m in re.finditer(r"\s+", text) if 0 < m.end() < len(text)]
    cut = min(gaps, key=lambda g: (abs(g - middle), g)) if gaps else middle
    return split_to_fit(text[:cut], limit, count) + split_to_fit(text[cut:], limit, count)


def words(text: str) -> int:
    """Space-separated words: the token count where no tokenizer is given."""
    return len(text.split())


def fit_inputs(passages: DataFrame, limit: int, count: Callable[[str], int] = words) -> DataFrame:
    """Parts of passages (chunk_id, content) that fit ``limit`` tokens: chunk_id, part, n_parts, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = split_to_fit(content or "", limit, count)
                rows += [{"chunk_id": key, "part": k, "n_parts": len(parts), "content": x} for k, x in enumerate(parts)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk_id", pa.string()), ("part", pa.int32()), ("n_parts", pa.int32()), ("content", pa.string())]))

    return passages.select("chunk_id", "content").mapInArrow(run, "chunk_id string, part int, n_parts int, content string")


def fnv1a(data: bytes) -> int:
    """32-bit FNV-1a."""
    h = 0x811C9DC5
    for byte in data:
        h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
    return h


def hash_vectors(texts: list[str], size: int = 384) -> np.ndarray:
    """Deterministic vectors without a model: counts of words hashed to ``size`` - 1 buckets, a constant last entry, unit length."""
    out = np.zeros((len(texts), size))
    slot: dict[str, int] = {}
    for row, text in enumerate(texts):
        for word in re.findall(r"[^\W_]+", text.lower()):
            if word not in slot:
                slot[word] = fnv1a(word.encode()) % (size - 1)
            out[row, slot[word]] += 1
        out[row, -1] = 0.1
    return unit_rows(out)


def embed(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray] = hash_vectors, batch: int = 256) -> DataFrame:
    """key and vector (array<float>) of each text, in batches, by an encoder that maps texts to rows of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            vectors = [v for k in range(0, len(texts), batch) for v in encode(texts[k : k + batch]).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "vector"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, vector array<float>")


@dataclass(frozen=True)
class Embedder:
    """An encoder of documents and one of queries; models that mark queries have two different ones."""

    documents: Callable[[list[str]], np.ndarray] = hash_vectors
    queries: Callable[[list[str]], np.ndarray] = hash_vectors


def embed_queries(queries: DataFrame, embedder: Embedder = Embedder()) -> DataFrame:
    """id and vector of queries (id, text): trimmed, each text encoded once; blank ones are left out."""
    asked = queries.select("id", F.trim("text").alias("text")).filter("text <> ''")
    return asked.join(embed(asked.select("text").distinct(), "text", "text", embedder.queries), "text").select("id", "vector")
