"""Queries over metadata: filters, pages, groups, paths, scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metadata as md
from ..operators.search import SearchOptions
from ..session import table
from .common import AS_OF, FILES_SQL, PART_SQL, document_files, part_concepts

FILTER = md.Query.parse({"where": {"types": ["PROMO", "SMALL", "LARGE"], "tags": ["red", "blue"], "required_tags": ["ring"]}})
PAGE = md.Query.parse({"where": {"title_contains": "RING", "statuses": ["stable", "draft"]}, "select": ["title", "type", "effective_status"], "order_by": [{"field": "title", "direction": "desc"}, {"field": "type"}]})
PREFIX = md.Query.parse({"where": {"path_prefixes": ["brand-1", "brand-12/promo", "brand-7/small/p6"]}})
TEXT = md.Query.parse({"where": {"description_contains": "OF SIZE 1", "title_contains": "bolt"}})


def q_filter_types_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(part_concepts(spark, sf_dir), FILTER).select("bundle", "id", "path", "title", "type", md.effective_status().alias("effective_status"))


def q_effective_status_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.group_counts(part_concepts(spark, sf_dir), "effective_status")


def q_type_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.group_counts(md.matching(part_concepts(spark, sf_dir), PREFIX), "type")


def q_contains_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.page(part_concepts(spark, sf_dir), PAGE, offset=10, limit=50)


def q_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.page_summary(part_concepts(spark, sf_dir), PAGE, offset=10, limit=50)


def q_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(part_concepts(spark, sf_dir), TEXT).select("id", "title", "description")


def q_path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(part_concepts(spark, sf_dir), PREFIX).select("id", "type", "title")


GLOBS = ("**/s1*/d*.md", "en/*/index.md", "f*7.png")


def q_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir).withColumns({"source_path": F.concat_ws("/", "bundle", "path"), "chunk_type": F.col("lang")})
    return files.filter(SearchOptions(file_patterns=GLOBS, chunk_types=("en", "fr")).column()).select("doc_id", "source_path")


def q_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir).withColumns({"source_path": F.concat_ws("/", "bundle", "path"), "chunk_type": F.col("lang")})
    return files.filter(SearchOptions(file_paths=("s3/d3.md", "src1/en/s21/", "de\\s5\\d5.md", "index.md")).column()).select("doc_id", "source_path")


def q_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("metadata", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"))))
    options = SearchOptions(metadata={"type": ["click", "view", "error"], "k": re.compile("^[1-4]")})
    return events.filter(options.column()).select("event_id", "event_type", F.col("metadata")["k"].alias("k"))


def q_file_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return files.groupBy("bundle", tx.file_kind(F.col("path")).alias("kind"), tx.content_type(F.col("path")).alias("content_type")).agg(F.count("*").alias("n"))


def q_implied_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("bundle", F.explode(tx.implied_directories(F.col("path"))).alias("directory")).distinct()


def q_current_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    concepts = orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 4 != 0).alias("has_status"),
        F.when(F.col("o_orderstatus") == "F", "deprecated").when(F.col("o_orderstatus") == "P", None).otherwise("draft").alias("status"),
        F.when(F.col("o_orderkey") % 10 == 0, "soon").when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("stale_after"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<struct<by:string>>"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.array(F.struct(F.lit("bot:check").alias("by")), F.struct(F.lit("human:kim").alias("by"))))
        .otherwise(F.array(F.struct(F.lit("bot:check").alias("by"))))
        .alias("verified"),
    )
    as_of = F.lit(AS_OF).cast("timestamp")
    return concepts.filter(md.current(as_of)).groupBy(md.effective_status().alias("status"), md.trust_tier(F.col("verified")).alias("trust")).agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def q_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_files(spark, sf_dir)
    name = F.concat_ws("-", "lang", F.col("bundle"))
    cited = tx.citation(F.col("path"), F.lit(3), F.lit(9))
    return d.select(
        "doc_id",
        tx.non_whitespace_length(F.col("text")).alias("budget"),
        tx.contains_text(F.col("text"), "License").alias("has_license"),
        tx.normalised_path(F.concat(F.lit(" "), F.translate("path", "/", "\\"), F.lit("// "))).alias("path"),
        tx.humanise(name).alias("label"),
        tx.counted(F.col("doc_id") % 3, "file").alias("files"),
        cited.alias("citation"),
        tx.parse_citation(cited)["end"].alias("cited_end"),
        tx.normalised_heading(F.col("text")).alias("heading"),
        tx.scoped_id(F.col("bundle"), F.col("path")).alias("scoped_id"),
        F.sha2("text", 256).alias("input_hash"),
        F.round(F.log2(F.col("doc_id") % 50 + 2.0), 6).alias("discount"),
        tx.line_at(F.col("text"), F.length("text")).alias("last_line"),
        F.least(F.greatest(F.col("doc_id") % 7, F.lit(1)), F.lit(3)).alias("depth"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "d MMM yyyy").alias("shown_date"),
        tx.concept_id(F.col("path")).alias("concept_id"),
        tx.escape_cell(F.col("text")).alias("cell"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        q_filter_types_tags, q_effective_status_group, q_type_group, q_contains_order_page, q_page_summary, q_text_filter, q_path_prefix,
        q_glob_filter, q_file_paths, q_metadata_filter, q_file_classify, q_implied_dirs, q_current_only, q_scalars,
    )
}

_PAGE_FILTER = "lower(title) LIKE '%ring%' AND effective_status IN ('stable', 'draft')"
_PREFIX_FILTER = "(id = 'brand-1' OR id LIKE 'brand-1/%' OR id = 'brand-12/promo' OR id LIKE 'brand-12/promo/%' OR id = 'brand-7/small/p6' OR id LIKE 'brand-7/small/p6/%')"
_PATH = "bundle || '/' || path"

ORACLES = {
    "q_filter_types_tags": f"SELECT bundle, id, path, title, type, effective_status FROM ({PART_SQL}) WHERE type IN ('PROMO', 'SMALL', 'LARGE') AND list_has_any(tags, ['red', 'blue']) AND list_contains(tags, 'ring')",
    "q_effective_status_group": f"SELECT effective_status AS key, count(*) AS count FROM ({PART_SQL}) GROUP BY 1",
    "q_type_group": f"SELECT type AS key, count(*) AS count FROM ({PART_SQL}) WHERE {_PREFIX_FILTER} GROUP BY 1",
    "q_contains_order_page": f"SELECT bundle, id, path, title, type, effective_status FROM ({PART_SQL}) WHERE {_PAGE_FILTER} ORDER BY title DESC NULLS LAST, type, bundle, id LIMIT 50 OFFSET 10",
    "q_page_summary": f"SELECT count(*) AS total, CAST(NULL AS BIGINT) AS group_total, least(greatest(count(*) - 10, 0), 50) AS returned, count(*) - 10 > 50 AS has_more FROM ({PART_SQL}) WHERE {_PAGE_FILTER}",
    "q_text_filter": f"SELECT id, title, description FROM ({PART_SQL}) WHERE contains(lower(description), 'of size 1') AND contains(lower(title), 'bolt')",
    "q_path_prefix": f"SELECT id, type, title FROM ({PART_SQL}) WHERE {_PREFIX_FILTER}",
    "q_glob_filter": rf"SELECT doc_id, {_PATH} AS source_path FROM ({FILES_SQL}) WHERE lang IN ('en', 'fr') AND (regexp_full_match({_PATH}, '(?:.*/)?(?:.*/)?s1[^/]*/d[^/]*\.md') OR regexp_full_match({_PATH}, '(?:.*/)?en/[^/]*/index\.md') OR regexp_full_match({_PATH}, '(?:.*/)?f[^/]*7\.png'))",
    "q_file_paths": f"SELECT doc_id, {_PATH} AS source_path FROM ({FILES_SQL}) WHERE {' OR '.join(f'({_PATH} = {n!r} OR suffix({_PATH}, {'/' + n!r}))' for n in ('s3/d3.md', 'src1/en/s21', 'de/s5/d5.md', 'index.md'))}",
    "q_metadata_filter": "SELECT event_id, event_type, k FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE event_type IN ('click', 'view', 'error') AND regexp_matches(k, '^[1-4]')",
    "q_file_classify": f"SELECT bundle, CASE WHEN NOT suffix(path, '.md') THEN 'asset' WHEN suffix(path, '/index.md') THEN 'index' ELSE 'concept' END AS kind, CASE WHEN suffix(path, '.md') THEN 'markdown' ELSE 'text' END AS content_type, count(*) AS n FROM ({FILES_SQL}) GROUP BY ALL",
    "q_implied_dirs": f"SELECT DISTINCT bundle, directory FROM (SELECT bundle, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS directory FROM ({FILES_SQL}))",
    "q_current_only": f"""
WITH c AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'deprecated' WHEN 'P' THEN NULL ELSE 'draft' END ELSE 'stable' END AS status,
    CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS stale_after,
    CASE WHEN o_orderkey % 5 = 0 THEN 'unverified' WHEN o_orderpriority = '1-URGENT' THEN 'human-reviewed' ELSE 'machine-confirmed' END AS trust
  FROM orders
)
SELECT status, trust, count(*) AS n, max(id) AS last_id FROM c
WHERE status IS DISTINCT FROM 'deprecated' AND NOT coalesce(TIMESTAMP '{AS_OF}' >= stale_after, false) GROUP BY ALL""",
    "q_scalars": rf"""
SELECT doc_id, CAST(length(regexp_replace(text, '[ \t-\r]', '', 'g')) AS INTEGER) AS budget, contains(lower(text), 'license') AS has_license, path,
  upper(lang[1]) || lang[2:] || ' ' || bundle AS label,
  (doc_id % 3) || ' file' || CASE WHEN doc_id % 3 = 1 THEN '' ELSE 's' END AS files,
  path || ':3-9' AS citation, CAST(9 AS INTEGER) AS cited_end, lower(trim(text)) AS heading,
  sha256('["' || bundle || '","' || path || '"]') AS scoped_id, sha256(text) AS input_hash, round(log2(doc_id % 50 + 2.0), 6) AS discount,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS last_line, least(greatest(doc_id % 7, 1), 3) AS depth,
  strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER), '%-d %b %Y') AS shown_date, regexp_replace(path, '\.md$', '') AS concept_id,
  regexp_replace(regexp_replace(text, '([\\|])', '\\\1', 'g'), '[\r\n]+', ' ', 'g') AS cell
FROM ({FILES_SQL})""",
}
