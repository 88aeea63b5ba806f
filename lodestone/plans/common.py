"""Views of the driver's tables as document collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: A time to ask about, fixed so that results repeat.
AS_OF = "1999-06-01 00:00:00"


def part_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as documents: brand and type make the path, the name is the title, its words are tags."""
    p = table(spark, sf_dir, "part")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    id_ = F.concat_ws("/", brand, F.lower("p_type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    status = F.when((F.col("p_size") % 3 == 0) | (F.col("p_size") % 5 == 0), None).when(F.col("p_size") % 7 == 0, "deprecated").when(F.col("p_size") % 2 == 0, "draft").otherwise("stable")
    return p.select(
        F.lit("parts").alias("bundle"),
        id_.alias("id"),
        F.concat(id_, F.lit(".md")).alias("path"),
        F.col("p_type").alias("type"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("title"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_name"), F.lit(" of size "), F.col("p_size").cast("string"))).alias("description"),
        (F.col("p_size") % 3 != 0).alias("has_status"),
        status.alias("status"),
        F.concat(F.array("p_brand"), F.split("p_name", " ")).alias("tags"),
        F.lit(None).cast("string").alias("resource"),
        "p_size",
    )


PART_SQL = """
SELECT 'parts' AS bundle, lower(replace(p_brand, '#', '-')) || '/' || lower(p_type) || '/p' || p_partkey AS id,
  lower(replace(p_brand, '#', '-')) || '/' || lower(p_type) || '/p' || p_partkey || '.md' AS path,
  p_type AS type, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS title,
  CASE WHEN p_size % 2 = 0 THEN p_name || ' of size ' || p_size END AS description,
  p_size % 3 <> 0 AS has_status,
  CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'deprecated' WHEN p_size % 2 = 0 THEN 'draft' ELSE 'stable' END AS status,
  CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'deprecated' WHEN p_size % 2 = 0 THEN 'draft' ELSE 'stable' END ELSE 'stable' END AS effective_status,
  list_concat([p_brand], string_split(p_name, ' ')) AS tags, p_size
FROM part
"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: bundle, path, kind and text; every 13th is an index, every 17th an asset."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 13 == 0, "index.md").when(F.col("doc_id") % 17 == 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")))
    folder = F.concat_ws("/", "lang", F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")))
    return d.select("doc_id", F.col("source").alias("bundle"), F.concat_ws("/", folder, name).alias("path"), "text", "lang")


FILES_SQL = """
SELECT doc_id, source AS bundle, lang || '/s' || (doc_id % 40) || '/' ||
  CASE WHEN doc_id % 13 = 0 THEN 'index.md' WHEN doc_id % 17 = 0 THEN 'f' || doc_id || '.png' ELSE 'd' || doc_id || '.md' END AS path, text, lang
FROM documents
"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with a word of each document as a passage, and each document as one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    path = F.concat_ws("/", "source", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    lines = d.select(path.alias("source_path"), F.posexplode(F.split("text", "\n")).alias("at", "content")).filter("trim(content) <> ''")
    return lines.select("source_path", (F.col("at") + 1).alias("line_start"), (F.col("at") + 1).alias("line_end"), F.lit("line").alias("chunk_type"), "content")


LINES_SQL = """
SELECT source || '/d' || doc_id || '.txt' AS source_path, pos AS line_start, pos AS line_end, 'line' AS chunk_type, content
FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
WHERE trim(content) <> ''
"""
