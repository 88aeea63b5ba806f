"""Snapshots of a collection: passages with their context, cut to what an encoder takes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fragment_id, scoped_id
from .passages import chunk, slices, words

#: A type whose documents are no source of passages, and the types of passages that are a document's apparatus.
EXCLUDED_TYPE = "Attested Computation"
APPARATUS = ("heading", "footnote")
#: Characters that a description may have to be part of the context.
MAX_DESCRIPTION = 240
#: What a fitted passage lost.
CONTEXT_OMITTED, SEGMENT_SPLIT = "embedding_context_omitted", "oversized_segment_split"


def passage_prefix(title: Column, description: Column, headings: Column, table_header: Column, language: Column) -> Column:
    """What stands before a passage in an encoder's input: title, description, section, table columns and code language."""
    label = lambda name, x, ok: F.when(ok, F.concat(F.lit(f"{name}: "), x))
    about = F.trim(description)
    return F.concat(
        F.concat_ws(
            "\n\n",
            label("Title", title, F.trim(title) != ""),
            label("Description", about, F.length(about).between(1, MAX_DESCRIPTION)),
            label("Section", F.array_join(headings, " > "), F.size(headings) > 0),
            label("Table columns", table_header, table_header.isNotNull()),
            label("Code language", language, language.isNotNull()),
            F.lit("Passage:"),
        ),
        F.lit("\n\n"),
    )


def snapshot(concepts: DataFrame, namespace: str, limit: int = 1000) -> DataFrame:
    """Passages of Markdown documents: id, source_path, lines, chunk_type, content, heading_path, prefix and input.

    ``concepts`` has path, type, title, description, body and body_line (the
    file's line where the body starts).  Headings become context and footnotes
    are left out, unless a body has nothing else.  Ids hash the namespace and
    the passage's place in the body, so a change of frontmatter alone keeps them;
    lines are those of the file.  A document without a title is named by its
    file.  Documents of type ``EXCLUDED_TYPE`` give no passages.
    """
    docs = concepts.filter(~F.col("type").eqNullSafe(EXCLUDED_TYPE))
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n")
    parts = chunk(docs.select(F.col("path").alias("source_path"), F.lit("markdown").alias("content_type"), body.alias("text")), limit)
    apparatus = F.col("chunk_type").isin(*APPARATUS)
    only = parts.groupBy("source_path").agg(F.bool_and(apparatus).alias("only"))
    kept = parts.join(only, "source_path").filter(~apparatus | F.col("only"))
    named = F.coalesce("title", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    about = docs.select(F.col("path").alias("source_path"), named.alias("title"), "description", (F.coalesce("body_line", F.lit(1)) - 1).alias("offset"))
    prefix = passage_prefix(F.col("title"), F.col("description"), F.col("heading_path"), F.col("table_header"), F.col("code_language"))
    return kept.join(about, "source_path").select(
        scoped_id(F.lit(namespace), F.col("chunk_id")).alias("id"),
        "source_path",
        (F.col("line_start") + F.col("offset")).cast("int").alias("line_start"),
        (F.col("line_end") + F.col("offset")).cast("int").alias("line_end"),
        "chunk_type",
        "content",
        "heading_path",
        F.when(F.col("parent_id").isNotNull(), scoped_id(F.lit(namespace), F.col("parent_id"))).alias("parent_heading_id"),
        prefix.alias("prefix"),
        F.concat(prefix, "content").alias("input"),
    )


def check_snapshot(passages: DataFrame, concepts: DataFrame) -> None:
    """Refuse a snapshot whose ids repeat, whose paths name no document, or whose lines run backwards."""
    repeated = passages.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    lost = passages.join(concepts.select(F.col("path").alias("source_path")), "source_path", "left_anti").select("source_path").distinct().limit(5).collect()
    odd = passages.filter("id is null or line_start is null or line_start < 1 or line_end < line_start").limit(5).collect()
    if repeated or lost or odd:
        raise ValueError(f"ids that repeat: {[r.id for r in repeated]}; paths of no document: {[r.source_path for r in lost]}; passages without id or lines: {[r.id for r in odd]}")


def cut_ranges(text: str, fits: Callable[[str], bool], by_line: bool) -> tuple[list[tuple[int, int]], bool] | None:
    """Ranges that cover ``text``, each of which fits, and whether a word had to be cut; None where that cannot be done.

    A range that does not fit is cut where white space ends, nearest to its
    middle; with ``by_line`` where a line ends, if it has several.
    """
    done: list[tuple[int, int]] = []
    todo, broken = [(0, len(text))], False
    while todo:
        start, end = todo.pop()
        part = text[start:end]
        if not part.strip():
            return None
        if fits(part):
            done.append((start, end))
            continue
        first, last = end - len(part.lstrip()), start + len(part.rstrip())
        middle = (first + last) // 2
        inside = lambda pattern: [start + m.end() for m in re.finditer(pattern, part) if first < start + m.end() < last]  # noqa: E731, B023
        places = (by_line and inside(r"\n")) or inside(r"\s+")
        cut = min(places, key=lambda at: (abs(at - middle), at)) if places else middle
        if not first < cut < last:
            return None
        broken |= not places
        todo += [(cut, end), (start, cut)]
    return done, broken


def fit_snapshot(passages: DataFrame, limit: int, count: Callable[[str], int] = words, with_context: bool = True) -> DataFrame:
    """Passages cut so that ``count`` of each encoder input is at most ``limit``; nothing of a passage is lost.

    A passage that cannot be cut to fit with its context is cut without it.
    Parts get ids of their own (parent's id and character range, in code
    points) and their lines; ``code`` says what happened (``CONTEXT_OMITTED``,
    ``SEGMENT_SPLIT`` or both, comma-joined; null for neither).  A passage that
    does not fit even so fails the job, and its path is named.
    """
    if limit < 1:
        raise ValueError("the limit is a positive number of tokens")

    def fitted(prefix: str, content: str, kind: str):
        for lead in [prefix, ""] if with_context else [""]:
            found = cut_ranges(content, lambda part: count(lead + part) <= limit, kind in ("table", "code"))  # noqa: B023
            if found:
                return lead, *found
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for p in batch.to_pylist():
                found = fitted(p["prefix"], p["content"], p["chunk_type"])
                if found is None:
                    raise ValueError(f"a passage of {p['source_path']} does not fit {limit} tokens")
                lead, ranges, broken = found
                codes = [CONTEXT_OMITTED] * (with_context and lead != p["prefix"]) + [SEGMENT_SPLIT] * broken
                for start, end in ranges:
                    part = p["content"][start:end]
                    line = p["line_start"] + p["content"].count("\n", 0, start)
                    whole = len(ranges) == 1
                    last = p["line_end"] if whole else line + part.rstrip().count("\n")
                    rows.append((p["id"], start, end, p["source_path"], p["chunk_type"], line, last, p["line_start"], p["line_end"], part, lead + part, whole, ",".join(codes) or None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)] if rows else [pa.array([], f.type) for f in shape], schema=shape)

    text, number = pa.string(), pa.int32()
    kinds = [text, number, number, text, text, number, number, number, number, text, text, pa.bool_(), text]
    names = ["parent", "character_start", "character_end", "source_path", "chunk_type", "line_start", "line_end", "original_start", "original_end", "content", "input", "whole", "code"]
    shape = pa.schema(list(zip(names, kinds)))
    schema = ", ".join(f"{n} {'boolean' if n == 'whole' else 'int' if k == number else 'string'}" for n, k in zip(names, kinds))
    parts = passages.select("id", "source_path", "chunk_type", "line_start", "line_end", "content", "prefix").mapInArrow(run, schema)
    part_id = fragment_id(F.col("parent"), F.col("character_start"), F.col("character_end"))
    return parts.select(F.when(F.col("whole"), F.col("parent")).otherwise(part_id).alias("id"), F.col("parent").alias("parent_chunk_id"), *[n for n in names if n not in ("parent", "whole")])


def fit_diagnostics(fitted: DataFrame) -> DataFrame:
    """source_path, code, line_start, line_end and affected: what fitting did to the passages of each document."""
    each = fitted.filter("code is not null").withColumn("code", F.explode(F.split("code", ",")))
    return each.groupBy("source_path", "code").agg(F.min("original_start").alias("line_start"), F.max("original_end").alias("line_end"), F.count_distinct("parent_chunk_id").alias("affected"))
