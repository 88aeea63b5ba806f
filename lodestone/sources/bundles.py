"""Bundles of Markdown documents as DataFrames."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_kind
from ..operators.sync import fingerprints
from ..session import written

CONCEPT_FIELDS = "struct<type:string,title:string,description:string,status:string,tags:array<string>,resource:string,stale_after:string>"


def read_files(spark: SparkSession, root: str, bundle: str, max_bytes: int | None = None, pattern: str | None = None) -> DataFrame:
    """Files of a bundle: bundle, path, kind, digest, n_bytes and, for Markdown, text.

    Files over ``max_bytes`` are listed without digest and text; hidden lock
    files are left out.  ``pattern`` is a glob of file names, as ``*.{ts,md}``.
    A byte order mark is dropped.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    prefix = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    path = F.regexp_replace(F.col("path"), r"^[A-Za-z]+:/*", "")
    path = F.substring(path, F.length(prefix) + 1, F.length(path))
    wanted = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    kind = file_kind(F.col("path"))
    files = raw.select(path.alias("path"), F.col("length").alias("n_bytes"), F.when(wanted, F.col("content")).alias("content")).filter(~F.col("path").rlike(r"(^|/)\.[^/]*\.lock$"))
    text = F.when(kind != "asset", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    return files.select(F.lit(bundle).alias("bundle"), "path", kind.alias("kind"), F.sha2("content", 256).alias("digest"), "n_bytes", text.alias("text"))


def split_frontmatter(text: Column) -> Column:
    """Struct of ``yaml`` (null without frontmatter), ``body`` and the body's first line."""
    pattern = r"(?s)^---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n|$)"
    head = F.regexp_extract(text, pattern, 0)
    there = head != ""
    return F.struct(
        F.when(there, F.regexp_extract(text, pattern, 1)).alias("yaml"),
        F.when(there, F.substring(text, F.length(head) + 1, F.length(text))).otherwise(text).alias("body"),
        F.when(there, 1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).otherwise(1).alias("body_line"),
    )


def _yaml_to_json(batches):
    """Frontmatter as JSON: yaml in, json and error out."""
    import yaml

    for batch in batches:
        out, errors = [], []
        for text in batch.column("yaml").to_pylist():
            try:
                value = yaml.load(text or "", Loader=yaml.BaseLoader) or {}
                ok = isinstance(value, dict)
                out.append(json.dumps(value, ensure_ascii=False, sort_keys=True) if ok else None)
                errors.append(None if ok else "frontmatter is not a mapping")
            except yaml.YAMLError as error:
                out.append(None)
                errors.append(str(error).split("\n")[0])
        keep = [n for n in batch.schema.names if n != "yaml"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, pa.string()), pa.array(errors, pa.string())], [*keep, "fm_json", "error"])


def read_concepts(files: DataFrame) -> DataFrame:
    """Documents of ``read_files``: id, path, fm_json, error, the known fields, has_status and the body.

    ``fm_json`` keeps every key; scalars are text.  A document with ``error``
    has no fields.  Reserved files and assets are no documents.
    """
    parts = files.filter("kind = 'concept'").withColumn("parts", split_frontmatter(F.col("text")))
    rows = parts.select("bundle", "path", F.col("parts.yaml").alias("yaml"), F.col("parts.body").alias("body"), F.col("parts.body_line").cast("int").alias("body_line"))
    read = rows.select("bundle", "path", "body", "body_line", "yaml").mapInArrow(_yaml_to_json, "bundle string, path string, body string, body_line int, fm_json string, error string")
    known = F.from_json("fm_json", CONCEPT_FIELDS)
    return read.select(
        "bundle", F.regexp_replace("path", r"\.md$", "").alias("id"), "path", "fm_json", "error",
        F.array_contains(F.json_object_keys("fm_json"), "status").alias("has_status"), known.alias("k"), "body", "body_line",
    ).select("bundle", "id", "path", "fm_json", "error", F.coalesce("has_status", F.lit(False)).alias("has_status"), "k.*", "body", "body_line")


def unreadable(concepts: DataFrame) -> DataFrame:
    """Documents that do not conform: unreadable frontmatter, or no type."""
    return concepts.filter("error is not null or type is null or trim(type) = ''").select("bundle", "path", F.coalesce("error", F.lit("type is missing")).alias("reason"))


def log_entries(files: DataFrame) -> DataFrame:
    """path, day and action of ``log.md`` files: list items below ``## YYYY-MM-DD`` headings."""
    logs = files.filter("kind = 'log'")
    blocks = logs.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^##\s+(\d{4}-\d{2}-\d{2}[^#]*)"), 1)).alias("block"))
    day = F.to_date(F.substring("block", 1, 10))
    return blocks.select("path", day.alias("day"), F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^\s*[*-]\s+(.+)$"), 1)).alias("action"))


def within_budget(files: DataFrame, max_total: int) -> DataFrame:
    """Files with ``fits``: whether they are among the first, by path, that hold ``max_total`` bytes together.

    Paths are ordered over range partitions; a file's bytes are added to those
    before it in its partition and to the sums of the partitions before, one row
    each, so that no task orders all files.  Null sizes count as 0.
    """
    ordered = files.repartitionByRange("path").sortWithinPartitions("path").withColumn("__at", F.monotonically_increasing_id())
    placed = written(ordered, "files-by-path").withColumn("__part", F.shiftright("__at", 33))  # the number of the partition; below it the place
    size = F.coalesce("n_bytes", F.lit(0))
    sums = placed.groupBy("__part").agg(F.sum(size).alias("__bytes"))
    before = F.coalesce(F.sum("__bytes").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    inside = F.sum(size).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part")
    return joined.withColumn("fits", F.col("__before") + inside <= max_total).drop("__at", "__part", "__before")


def reserved_file_faults(files: DataFrame) -> DataFrame:
    """bundle, path and reason of index and log files whose structure does not conform.

    An index below the root has no frontmatter; a log has dated level-two
    headings only, newest first.
    """
    index = files.filter("kind = 'index' and path like '%/%'").filter(split_frontmatter(F.col("text"))["yaml"].isNotNull())
    dates = F.regexp_extract_all("text", F.lit(r"(?m)^##[ \t]+(.*?)[ \t]*$"), 1)
    logs = files.filter("kind = 'log'").withColumn("dates", dates)
    bad = F.exists("dates", lambda x: F.try_to_date(x, "yyyy-MM-dd").isNull())
    late = ~F.coalesce(F.array_sort("dates") == F.reverse("dates"), F.lit(True))
    said = F.when(bad, "a log heading is no date").when(late, "the newest log entry is not first")
    return index.select("bundle", "path", F.lit("an index below the root has frontmatter").alias("reason")).unionByName(logs.withColumn("reason", said).filter("reason is not null").select("bundle", "path", "reason"))


def live_concepts(spark: SparkSession, root: str, bundle: str) -> tuple[DataFrame, str]:
    """Documents of a collection as it is now, with the fingerprint of its files; a collection that does not conform is refused.

    ``still`` tells afterwards whether the files are the same.
    """
    files = read_files(spark, root, bundle)
    concepts = read_concepts(files)
    faults = unreadable(concepts).unionByName(reserved_file_faults(files)).limit(5).collect()
    if faults:
        raise ValueError(f"the collection does not conform: {[(r.path, r.reason) for r in faults]}")
    return concepts, fingerprint_of(files)


def fingerprint_of(files: DataFrame) -> str:
    """One digest of all paths and contents, in any order of the files."""
    row = fingerprints(files.select(F.lit(1).alias("all"), "path", "digest"), "all", "path", "digest").first()
    return row.fingerprint if row else ""


def still(spark: SparkSession, root: str, bundle: str, fingerprint: str) -> bool:
    """Whether the files of a collection are those of a fingerprint."""
    return fingerprint_of(read_files(spark, root, bundle)) == fingerprint
