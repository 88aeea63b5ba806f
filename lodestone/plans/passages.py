"""Queries that cut texts into passages and embed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import passages as ps
from ..session import table


def _documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("source_path"), F.lit(kind).alias("content_type"), "text")


def q_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed to 1000 characters."""
    return ps.chunk(_documents(spark, sf_dir, "lines")).select("source_path", "line_start", "line_end", "chunk_type", "content", "chunk_id")


def q_chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, and those over 400 characters by sentence."""
    return ps.chunk(_documents(spark, sf_dir, "sentences"), 400).select("source_path", "line_start", "line_end", "chunk_type", "content", "chunk_id")


def q_chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of texts in which each line is one."""
    d = _documents(spark, sf_dir, "text").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return ps.chunk(d).select("source_path", "line_start", "line_end", "chunk_id", "content")


def q_markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as Markdown: a heading for each role, and the turns."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"])), "\n\n")
    d = turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("source_path"), F.lit("markdown").alias("content_type"), text.alias("text"))
    return ps.chunk(d).withColumn("heading_path", F.array_join("heading_path", " > ")).select("source_path", "line_start", "line_end", "chunk_type", "heading_path", "content", "chunk_id")


def q_ts_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands written as TypeScript classes, with a method for each part; a file has up to 1000 part numbers."""
    file = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.floor(F.col("p_partkey") / 1000).cast("string"))
    parts = table(spark, sf_dir, "part").withColumn("brand", file)
    method = F.concat(F.lit("  // "), F.col("p_name"), F.lit("\n  part"), F.col("p_partkey").cast("string"), F.lit("(n: number) {\n    return `}${n}`;\n  }\n"))
    classes = parts.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", method.alias("m")))).alias("ms"))
    text = F.concat(F.lit("export class "), F.col("brand"), F.lit(" {\n"), F.array_join(F.transform("ms", lambda x: x["m"]), ""), F.lit("}\n"))
    d = classes.select(F.concat("brand", F.lit(".ts")).alias("source_path"), F.lit("typescript").alias("content_type"), text.alias("text"))
    return ps.chunk(d, 1600).select("source_path", "line_start", "line_end", "chunk_type", "symbol", "parent_symbol", "truncated", "content", "chunk_id")


def q_fit_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut to at most 64 words."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("text").alias("content"))
    return ps.fit_inputs(c, 64)


def q_word_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed word vectors of turns, with their number of filled buckets."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "text")
    v = ps.embed(c, "chunk_id", "text")
    return v.select("chunk_id", F.size(F.filter("vector", lambda x: x > 0)).alias("filled"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))


QUERIES = {f.__name__: f for f in (q_chunk_lines, q_chunk_sentences, q_chunk_paragraphs, q_markdown_chunks, q_ts_chunks, q_fit_inputs, q_word_hash_embed)}

_METHOD = "'  // ' || p_name || chr(10) || '  part' || p_partkey || '(n: number) {' || chr(10) || '    return `}${n}`;' || chr(10) || '  }'"

ORACLES = {
    "q_ts_chunks": f"""
WITH m AS (
  SELECT replace(p_brand, '#', '') || '_' || (p_partkey // 1000) AS brand, p_partkey, {_METHOD} AS content, 2 + 4 * (row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) - 1) AS line_start FROM part
), rows AS (
  SELECT brand || '.ts' AS source_path, line_start, line_start + 3 AS line_end, 'method' AS chunk_type, 'part' || p_partkey AS symbol, brand AS parent_symbol, CAST(NULL AS BOOLEAN) AS truncated, content FROM m
  UNION ALL
  SELECT brand || '.ts', 1, CASE WHEN big THEN 1 ELSE n END, 'class', brand, NULL, CASE WHEN big THEN true END, CASE WHEN big THEN 'export class ' || brand ELSE body END
  FROM (SELECT brand, 4 * count(*) + 2 AS n, 'export class ' || brand || ' {{' || chr(10) || string_agg(content, chr(10) ORDER BY p_partkey) || chr(10) || '}}' AS body, length(regexp_replace(body, '[ \t-\r]', '', 'g')) > 1600 AS big FROM m GROUP BY brand)
)
SELECT *, sha1(source_path || '|' || line_start || '|' || line_end || '|' || chunk_type || '|' || sha1(content)) AS chunk_id
FROM (SELECT source_path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, chunk_type, symbol, parent_symbol, truncated, content FROM rows)""",
    "q_chunk_paragraphs": r"""
WITH p AS (
  SELECT source || '/d' || doc_id AS source_path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
)
SELECT source_path, CAST(2 * pos - 1 AS INTEGER) AS line_start, CAST(2 * pos - 1 AS INTEGER) AS line_end,
  sha1(source_path || '|' || (2 * pos - 1) || '|' || (2 * pos - 1) || '|paragraph|' || sha1(content)) AS chunk_id, content
FROM p WHERE trim(content) <> ''""",
}
