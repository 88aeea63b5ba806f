"""Queries over link graphs, directory trees and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import titles as ti
from ..session import table
from .common import FILES_SQL, PART_SQL, document_files, part_concepts


def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.page_links(table(spark, sf_dir, "pages"))


def q_link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved against an inventory of the words of documents."""
    links = q_links(spark, sf_dir).select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/index.html")).alias("source"), "page_id", "ordinal", F.when(F.col("ordinal") % 5 == 4, F.concat(F.lit("https://example.com"), F.col("raw_target"))).when(F.col("ordinal") % 5 == 3, F.concat(F.lit("../.."), F.col("raw_target"))).otherwise(F.col("raw_target")).alias("raw_target"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("path")).filter("path <> ''").distinct()
    inventory = words.select("path", F.when(F.length("path") % 2 == 0, "concept").otherwise("asset").alias("kind"))
    return gr.resolve(links, inventory).select("page_id", "ordinal", "raw_target", "resolution", "resolved_path")


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between suppliers: a supplier of a line item links to the one 1, 2 or 3 numbers on, by the item's line."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey")
    return items.crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("source"), ((F.col("l_suppkey") + F.col("l_orderkey") % 4) % F.col("n")).alias("target"))


_SUPPLY_SQL = "SELECT l_suppkey AS source, (l_suppkey + l_orderkey % 4) % (SELECT count(*) FROM supplier) AS target FROM lineitem"


def q_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.backlinks(_supply(spark, sf_dir)).withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


def q_backlink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked pair as a row, however many sources a target has."""
    return gr.backlink_rows(_supply(spark, sf_dir))


def q_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.inbound_counts(_supply(spark, sf_dir))


def q_induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").filter("s_acctbal > 4000").select(F.col("s_suppkey").alias("node"))
    return gr.induced(_supply(spark, sf_dir), nodes).groupBy("source", "target").agg(F.count("*").alias("n"))


def q_merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.merged_pairs(_supply(spark, sf_dir))


def q_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degrees(_supply(spark, sf_dir))


def q_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers up to two links from the nation 3's."""
    seeds = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("node"))
    return gr.neighbourhood(_supply(spark, sf_dir), seeds, 2)


def q_file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.directories(document_files(spark, sf_dir))


def q_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a query of two words, with their scores."""
    return ti.title_matches(part_concepts(spark, sf_dir), "red ring")


def q_title_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.best_titles(part_concepts(spark, sf_dir), "Bolt", 25)


def q_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the word ``that`` of every document that has it."""
    d = table(spark, sf_dir, "documents").filter(F.lower("text").contains("that"))
    return d.select("doc_id", ti.snippet(F.col("text"), "that").alias("snippet"))


QUERIES = {
    f.__name__: f
    for f in (q_links, q_link_resolution, q_backlinks, q_backlink_rows, q_inbound, q_induced_subgraph, q_merged_pairs, q_degrees, q_khop, q_file_tree, q_title_search, q_title_best, q_snippet)
}

_LINKS_SQL = """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS ordinal, raw_target FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw_target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages)"""


def _score(field: str, word: str) -> str:
    return f"(CASE WHEN {field} IS NULL OR {field} = '' THEN 0 WHEN {field} = '{word}' THEN 1000 WHEN prefix({field}, '{word}') THEN 900 WHEN regexp_matches({field}, '(^|[^a-z0-9]){word}') THEN 700 WHEN contains({field}, '{word}') THEN 500 ELSE 0 END)"


def _best(word: str) -> str:
    return f"greatest({_score('lower(title)', word)}, CAST(round({_score('lower(id)', word)} * 0.6) AS INTEGER), CAST(round(list_max(list_transform(tags, lambda t: {_score('lower(t)', word)})) * 0.7) AS INTEGER))"


def _titles_sql(words: list[str]) -> str:
    whole, each = _score("lower(title)", " ".join(words)), [_best(w) for w in words]
    mean = f"CASE WHEN least({', '.join(each)}, 1000) > 0 THEN CAST(round(({' + '.join(each)}) / {len(words)}) AS INTEGER) ELSE 0 END"
    return f"SELECT * FROM (SELECT id, title, CAST(CASE WHEN {whole} > 0 THEN {whole} + 200 ELSE {mean} END AS INTEGER) AS score FROM ({PART_SQL})) WHERE score > 0"


ORACLES = {
    "q_links": _LINKS_SQL,
    "q_link_resolution": f"""
WITH l AS (
  SELECT page_id, ordinal, CASE ordinal % 5 WHEN 4 THEN 'https://example.com' || raw_target WHEN 3 THEN '../..' || raw_target ELSE raw_target END AS raw_target, substr(raw_target, 2) AS path FROM ({_LINKS_SQL})
), inventory AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]')) AS path FROM documents)
SELECT page_id, ordinal, raw_target, CASE WHEN ordinal % 5 = 4 THEN 'external' WHEN ordinal % 5 = 3 THEN 'invalid' WHEN i.path IS NULL THEN 'unresolved' WHEN length(i.path) % 2 = 0 THEN 'resolvedConcept' ELSE 'resolvedAsset' END AS resolution,
  CASE WHEN ordinal % 5 < 3 THEN i.path END AS resolved_path
FROM l LEFT JOIN inventory i ON l.path = i.path AND i.path <> ''""",
    "q_backlinks": f"SELECT target, count(*) AS n_links, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM ({_SUPPLY_SQL}) WHERE source <> target GROUP BY 1",
    "q_backlink_rows": f"SELECT target, source, count(*) AS n_links FROM ({_SUPPLY_SQL}) WHERE source <> target GROUP BY ALL",
    "q_inbound": f"SELECT target, count(*) AS n_links FROM ({_SUPPLY_SQL}) WHERE source <> target GROUP BY 1",
    "q_induced_subgraph": f"WITH n AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) SELECT source, target, count(*) AS n FROM ({_SUPPLY_SQL}) WHERE source IN (SELECT * FROM n) AND target IN (SELECT * FROM n) GROUP BY ALL",
    "q_merged_pairs": f"SELECT least(source, target) AS a, greatest(source, target) AS b, bool_or(source <= target) AS forward, bool_or(source > target) AS backward, count(*) AS n_links FROM ({_SUPPLY_SQL}) WHERE source <> target GROUP BY ALL",
    "q_degrees": f"SELECT node, count(*) AS degree FROM (SELECT unnest([source, target]) AS node FROM ({_SUPPLY_SQL})) GROUP BY 1",
    "q_khop": f"""
WITH e AS (SELECT DISTINCT * FROM (SELECT source AS a, target AS b FROM ({_SUPPLY_SQL}) UNION ALL SELECT target, source FROM ({_SUPPLY_SQL}))),
s AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey = 3),
one AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT * FROM s)),
two AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT * FROM one))
SELECT node, CAST(min(d) AS INTEGER) AS distance FROM (SELECT node, 0 AS d FROM s UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY 1""",
    "q_file_tree": f"SELECT directory, count(*) AS n_files, CAST(len(string_split(directory, '/')) - 1 AS INTEGER) AS depth FROM (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS directory FROM ({FILES_SQL})) GROUP BY 1",
    "q_title_search": _titles_sql(["red", "ring"]),
    "q_title_best": _titles_sql(["bolt"]) + " ORDER BY score DESC, length(title), title, id LIMIT 25",
}
