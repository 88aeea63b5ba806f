"""Queries over snapshots, composed index search, fact tables and rules as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import facts as fa
from ..operators import graph as gr
from ..operators import index_search as ix
from ..operators import snapshot as sn
from ..operators import titles as ti
from ..session import table
from . import search as search_plans
from .common import PART_SQL, part_concepts

NAMESPACE = "chats"


def chat_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as Markdown documents: a heading for the conversation and one for each turn, then its text and a note."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text"))).alias("t"))
    lines = F.concat(F.lit("## turn "), F.col("turn").cast("string"), F.lit(" of "), F.col("t.role"), F.lit("\n\n> "), F.col("t.text"), F.lit("\n\n[^t"), F.col("turn").cast("string"), F.lit("]: said\n"))
    body = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("line")))), lambda x: x["line"]), "\n").alias("rest"))
    id_ = F.col("conv_id").cast("string")
    return body.select(
        F.concat(F.lit("chats/c"), id_, F.lit(".md")).alias("path"),
        F.when(F.col("conv_id") % 7 == 0, sn.EXCLUDED_TYPE).otherwise("Chat").alias("type"),
        F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("Chat "), id_)).alias("title"),
        F.when(F.col("conv_id") % 2 == 0, F.lit(" A logged talk. ")).when(F.col("conv_id") % 5 == 0, F.repeat(F.lit("long "), 60)).alias("description"),
        F.concat(F.lit("# chat\n\n"), "rest").alias("body"),
        (F.col("conv_id") % 4 + 1).cast("int").alias("body_line"),
    )


def q_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with their context: one for each turn, under two headings."""
    return sn.snapshot(chat_concepts(spark, sf_dir), NAMESPACE).select("id", "source_path", "line_start", "line_end", F.array_join("heading_path", "/").alias("headings"), "parent_heading_id", "input")


def q_fit_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot inputs of at most 40 words."""
    return sn.fit_snapshot(sn.snapshot(chat_concepts(spark, sf_dir), NAMESPACE), 40).select("id", "parent_chunk_id", "character_start", "character_end", "line_start", "line_end", "input", "code")


def q_fit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.fit_diagnostics(sn.fit_snapshot(sn.snapshot(chat_concepts(spark, sf_dir), NAMESPACE), 15))


def label_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Passages, vectors, documents, queries and edges: labels are documents, vectors are their passages."""
    v = search_plans._vectors(spark, sf_dir)
    path = F.concat(F.lit("l"), (F.col("label") % 2).cast("string"), F.lit("/d"), F.col("label").cast("string"), F.lit(".md"))
    passages = v.select(F.format_string("v%08d", "id").alias("id"), path.alias("source_path"), F.col("id").alias("line_start"), F.col("id").alias("line_end"), F.lit("text").alias("content"))
    vectors = v.select(F.format_string("v%08d", "id").alias("id"), "vector")
    labels = v.select("label").distinct()
    documents = labels.select(
        path.alias("path"),
        tx.concept_id(path).alias("id"),
        F.when(F.col("label") % 3 == 0, "Guide").otherwise("Note").alias("type"),
        F.lit(True).alias("has_status"),
        F.when(F.col("label") == 4, "deprecated").otherwise("stable").alias("status"),
        F.when(F.col("label") == 7, "1999-01-01T00:00:00Z").alias("stale_after"),
    )
    queries = v.filter("id % 20 = 0").select("id", "vector")
    to = F.when(F.col("ordinal") == 1, (F.col("label") + 5) % 10).otherwise((F.col("label") + 3) % 10)
    target = F.concat(F.lit("l"), (to % 2).cast("string"), F.lit("/d"), to.cast("string"), F.lit(".md"))
    hops = labels.select("label", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    broken = (F.col("ordinal") == 2) & (F.col("label") % 4 == 1)
    edges = hops.select(
        path.alias("source"),
        "ordinal",
        F.when(broken, "gone.md").otherwise(target).alias("raw_target"),
        F.when(broken, "unresolved").otherwise("resolvedConcept").alias("resolution"),
        F.when(~broken, target).alias("resolved_path"),
    )
    return passages, vectors, documents, queries, edges


POLICY = ix.Policy(current_only=True, as_of=None, statuses=("stable",), path_prefixes=("l0", "l1"), governing={"l0/d2.md": "l0/d0.md", "l0/d6.md": "l0/d4.md", "l0/d8.md": "l0/d2.md"}, expand=True)


def _found(spark: SparkSession, sf_dir: str) -> ix.Found:
    passages, vectors, documents, queries, edges = label_index(spark, sf_dir)
    return ix.search_index(passages, vectors, documents, queries, POLICY, limit=2, context_limit=5, edges=edges)


def q_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two best documents of each query among those that the policy allows."""
    return _found(spark, sf_dir).matches


def q_index_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with what governs and what they link to, five documents a query."""
    return _found(spark, sf_dir).context


def q_index_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).notices.select("query_id", "position", "message", F.array_join("paths", ",").alias("paths"))


def q_policy_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each variant of the policy gives, by why they are there."""
    passages, vectors, documents, queries, edges = label_index(spark, sf_dir)
    return ix.search_variants(passages, vectors, documents, queries, POLICY, 2, edges).groupBy("variant", "reason").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files, with an index in the directories of every third brand and a log at the root."""
    parts = part_concepts(spark, sf_dir).select("path")
    index = parts.select(F.concat(F.split("path", "/")[0], F.lit("/index.md")).alias("path")).distinct().filter("length(path) % 3 = 0")
    own = spark.createDataFrame([("index.md",), ("log.md",), ("logo.png",)], "path string")
    return parts.unionByName(index).unionByName(own)


def q_directory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.directory_facts(_files(spark, sf_dir))


def q_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.file_facts(_files(spark, sf_dir)).groupBy("markdown", F.length("name").alias("length")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents whose bodies refer to and define footnotes, also inside of code."""
    c = part_concepts(spark, sf_dir)
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit("# Part "), size, F.lit(" \ntext[^a] and [^s"), size, F.lit("] `[^code]`\n```\n[^fenced]\n```\n# Notes #\n[^a]: see [^inner]\n[^b]: never used\n"))
    return c.select("path", "type", "status", F.array(F.lit("type"), F.lit("tags")).alias("keys"), "tags", F.array(F.lit("a"), F.concat(F.lit("s"), (F.col("p_size") % 9).cast("string"))).alias("source_ids"), body.alias("body"), "p_size")


def q_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes of documents against the ids of their sources."""
    facts = fa.concept_facts(_noted(spark, sf_dir), _files(spark, sf_dir))
    return facts.select("path", F.posexplode("footnotes").alias("at", "f")).select("path", "at", "f.value", "f.referenced", "f.defined", "f.is_source_id")


def q_concept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with their counts, headings as compared, and sibling directories."""
    files = _files(spark, sf_dir).unionByName(_noted(spark, sf_dir).filter("p_size % 4 = 0").select(F.concat(tx.concept_id(F.col("path")), F.lit("/more.txt")).alias("path")))
    tags = F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["value"], t["count"].cast("string"))), ",")
    headings = F.array_join(F.transform("headings", lambda h: h["normalized"]), "|")
    return fa.concept_facts(_noted(spark, sf_dir), files).select("path", tags.alias("tags"), headings.alias("headings"), "sibling_directory")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links of orders to parts, typed by their line, some of them broken or external."""
    items = table(spark, sf_dir, "lineitem")
    resolution = F.when(F.col("l_partkey") % 11 == 0, "unresolved").when(F.col("l_partkey") % 13 == 0, "external").when(F.col("l_partkey") % 5 == 0, "resolvedAsset").otherwise("resolvedConcept")
    target = F.concat(F.when(F.col("l_linenumber") == 1, "/").otherwise(""), F.lit("p"), F.col("l_partkey").cast("string"))
    resolved = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return items.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"),
        F.when(F.col("l_linenumber") % 2 == 0, "relationships").otherwise(gr.BODY).alias("origin"),
        F.col("l_linenumber").alias("ordinal"),
        target.alias("raw_target"),
        resolution.alias("resolution"),
        F.when(resolution.isin(*fa.RESOLVED), resolved).alias("resolved_path"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).alias("relationship"),
    )


def q_link_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fa.link_facts(_edges(spark, sf_dir))
    count = lambda name, test: F.size(F.filter(name, test)).cast("long")
    return facts.select("path", F.size("edges").cast("long").alias("n_edges"), count("edges", lambda x: x["internal"]).alias("n_internal"), count("edges", lambda x: x["bundle_relative"]).alias("n_rooted"), count("relationships", lambda x: x["resolved"]).alias("n_resolved"))


def q_inbound_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.inbound_facts(_edges(spark, sf_dir)).groupBy("path", "relationship").agg(F.count("*").alias("n"), F.min("from").alias("first_from"))


def q_typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers' nations linked by line items: one row a pair, with labels and origins."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("s"), ((F.col("l_suppkey") + F.col("l_orderkey") % 4) % 97).cast("string")).alias("target"),
        F.when(F.col("l_linenumber") % 2 == 0, "relationships").otherwise(gr.BODY).alias("origin"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lower("l_returnflag")).alias("relationship"),
    )
    return gr.merged_pairs(items).withColumns({"labels": F.array_join("labels", ","), "origins": F.array_join("origins", ",")})


def q_link_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = gr.layers(_edges(spark, sf_dir), ("attachments", "external", "unresolved"))
    return shown.groupBy("layer", "target").agg(F.count("*").alias("n"))


def _scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers around those of nation 3, with the parts that their line items of return flag R name as attachments."""
    items = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "supplier").count()
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    part = F.col("l_returnflag") == "R"
    target = F.when(part, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).otherwise(name((F.col("l_suppkey") + F.col("l_orderkey") % 4) % n))
    links = items.select(name(F.col("l_suppkey")).alias("source"), target.alias("raw_target"), F.when(part, "resolvedAsset").otherwise("resolvedConcept").alias("resolution"), target.alias("resolved_path"))
    seeds = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(name(F.col("s_suppkey")).alias("node"))
    return gr.local_scene(links, seeds, 2, ("concepts", "attachments"))


def q_scene_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene(spark, sf_dir)[0]


def q_scene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene(spark, sf_dir)[1].groupBy("source", "target", "layer").agg(F.count("*").alias("n"))


RULES = [
    fa.Rule("plain-tags", "concept", {"type": "object", "properties": {"value": {"pattern": "^[a-z]+$"}}}, "{path} has odd tags: {failing}", "warning", each="tags", failing_field="value"),
    fa.Rule("tags-once", "concept", {"type": "object", "properties": {"count": {"const": 1}}}, "repeated: {failing}", "error", each="tags", failing_field="value"),
    fa.Rule("known-notes", "concept", {"type": "object", "properties": {"is_source_id": {"const": True}}}, "no source for {failing} in {type} {nothing}", "suggestion", each="footnotes", failing_field="value"),
    fa.Rule("has-index", "directory", {"type": "object", "properties": {"has_index": {"const": True}}}, "add {index}", "warning", at="index"),
    fa.Rule("linked", "concept", {"minItems": 1}, "nothing refers to {path}", "warning", each="edges", needs_links=True),
]


def q_rule_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as data over fact tables; links could not be read, so the rule that needs them is left out."""
    files = _files(spark, sf_dir)
    facts = {"concept": fa.concept_facts(_noted(spark, sf_dir), files), "directory": fa.directory_facts(files)}
    return fa.evaluate(RULES, facts, links=False)


def q_findings_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.groups_in_order(q_rule_loop(spark, sf_dir), "rule_id")


def q_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of label groups, weighed by their queries, beside those of every third label."""
    means = search_plans.q_metric_groups(spark, sf_dir)
    return ev.weighted_means(means.withColumn("part", F.col("query_group") % 3), "part")


def q_tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file tree shows for the word ``gear``, with one file that is open."""
    files = part_concepts(spark, sf_dir).select("path", F.coalesce("title", F.lit("")).alias("label"), "type", "tags")
    return ti.tree_filter(files, " Gear ", keep="brand-1/none/p0.md").groupBy("is_file").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"))


def q_type_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.type_tree(part_concepts(spark, sf_dir).select(F.when(F.col("p_size") % 6 == 0, "").when(F.col("p_size") % 6 == 1, F.lower("type")).otherwise(F.col("type")).alias("type")))


def q_resource_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names of pinned commits, addresses and paths of all pages."""
    p = table(spark, sf_dir, "pages")
    pin = F.concat(F.lit(" git:"), F.upper(F.substring(F.sha1("url"), 1, 12)), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(":docs/p"), F.col("page_id").cast("string"), F.lit(".md/"))).otherwise(""))
    path = F.concat(F.lit("a/b"), F.col("page_id").cast("string"), F.lit("//"))
    return p.select("page_id", tx.resource_label(pin).alias("pin"), tx.short_target(F.concat(F.lit("https://Example.com/x/p"), F.col("page_id").cast("string"), F.lit("/?q=1#f"))).alias("address"), tx.short_target(path).alias("path"), tx.is_git_resource(F.col("url")).alias("url_is_pin"))


QUERIES = {
    f.__name__: f
    for f in (
        q_snapshot, q_fit_snapshot, q_fit_diagnostics, q_index_search, q_index_context, q_index_notices, q_policy_variants, q_directory_facts, q_file_facts, q_footnotes, q_concept_facts,
        q_link_facts, q_inbound_facts, q_typed_pairs, q_link_layers, q_scene_nodes, q_scene_edges, q_rule_loop, q_findings_in_groups, q_weighted_means, q_tree_filter, q_type_tree, q_resource_labels,
    )
}

_SNAPSHOT_SQL = """
WITH t AS (
  SELECT conv_id, turn, min((coalesce(role, ''), regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g'))) AS t FROM conversations GROUP BY ALL
), n AS (
  SELECT conv_id, turn, t[1] AS role, t[2] AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, conv_id % 4 AS off FROM t WHERE conv_id % 7 <> 0
), p AS (
  SELECT *, 'chats/c' || conv_id || '.md' AS source_path, CAST(2 + 6 * (k - 1) + 1 AS INTEGER) AS h, '> ' || said AS content,
    rtrim('turn ' || turn || ' of ' || role) AS heading
  FROM n
), i AS (
  SELECT *, sha1(source_path || '|' || (h + 2) || '|' || (h + 2) || '|paragraph|' || sha1(content)) AS raw,
    sha1(source_path || '|' || h || '|' || h || '|heading|' || sha1(heading)) AS raw_parent
  FROM p
)
SELECT sha256('["chats","' || raw || '"]') AS id, source_path, CAST(h + 2 + off AS INTEGER) AS line_start, CAST(h + 2 + off AS INTEGER) AS line_end, 'chat/' || heading AS headings,
  sha256('["chats","' || raw_parent || '"]') AS parent_heading_id,
  'Title: ' || CASE WHEN conv_id % 3 <> 0 THEN 'Chat ' || conv_id ELSE 'c' || conv_id END || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'Description: A logged talk.' ELSE '' END
    || chr(10) || chr(10) || 'Section: chat > ' || heading || chr(10) || chr(10) || 'Passage:' || chr(10) || chr(10) || content AS input
FROM i"""

_FILES_SQL = f"""
(SELECT path FROM ({PART_SQL}) UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/index.md' FROM ({PART_SQL}) WHERE length(split_part(path, '/', 1) || '/index.md') % 3 = 0
 UNION ALL SELECT unnest(['index.md', 'log.md', 'logo.png']))"""
_DIRECTORY_SQL = f"""
SELECT DISTINCT d AS path, d || '/index.md' IN (SELECT path FROM {_FILES_SQL}) AS has_index, d || '/index.md' AS "index"
FROM (SELECT unnest([split_part(path, '/', 1), CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END]) AS d FROM {_FILES_SQL} WHERE contains(path, '/'))
WHERE d IS NOT NULL"""
_NOTES_SQL = f"""
SELECT path, type, p_size, unnest(notes) AS value, generate_subscripts(notes, 1) AS pos FROM (SELECT *, ['a', 's' || p_size, 'b'] AS notes FROM ({PART_SQL}))"""
_EDGES_SQL = """
SELECT 'o' || l_orderkey AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'relationships' ELSE 'bodyLink' END AS origin, l_linenumber AS ordinal, CASE WHEN l_linenumber = 1 THEN '/p' ELSE 'p' END || l_partkey AS raw_target,
  CASE WHEN l_partkey % 11 = 0 THEN 'unresolved' WHEN l_partkey % 13 = 0 THEN 'external' WHEN l_partkey % 5 = 0 THEN 'resolvedAsset' ELSE 'resolvedConcept' END AS resolution,
  CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 THEN 'p' || l_partkey END AS resolved_path, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) END AS relationship FROM lineitem"""
_OK = "label <> 4 AND label <> 7"
_BEST_SQL = f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, source_path, id, sim, label FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, source_path, id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, id) AS n FROM (
      SELECT q.vec_id AS query_id, v.label, 'l' || (v.label % 2) || '/d' || v.label || '.md' AS source_path, printf('v%08d', v.vec_id) AS id,
        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS sim
      FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.{_OK.replace('label <> 7', 'v.label <> 7')})) WHERE n = 1) WHERE rank <= 2"""
_PATH_OF = "'l' || ({0} % 2) || '/d' || ({0}) || '.md'"
_CONTEXT_SQL = f"""
WITH first AS (SELECT label, printf('v%08d', min(vec_id)) AS first_id FROM embeddings WHERE {_OK} GROUP BY 1),
m AS ({_BEST_SQL}),
edge AS (SELECT label AS src, o AS ordinal, CASE o WHEN 1 THEN (label + 5) % 10 ELSE (label + 3) % 10 END AS dst, o = 2 AND label % 4 = 1 AS broken FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest([1, 2]) AS o)),
want AS (
  SELECT query_id, rank, -1 AS ordinal, label, id, 'match' AS reason, CAST(NULL AS INTEGER) AS via FROM m
  UNION ALL SELECT query_id, rank, ordinal, dst, first_id, 'relationship', m.label FROM m JOIN edge ON m.label = src AND NOT broken JOIN first ON first.label = dst
), gov AS (SELECT unnest([2, 8, 8]) AS label, unnest([1, 1, 2]) AS k, unnest([0, 2, 0]) AS governor, unnest([2, 8, 2]) AS lower),
every AS (
  SELECT *, 1000000 AS up FROM want
  UNION ALL SELECT query_id, rank, ordinal, governor, first_id, 'governing', lower, -k FROM want JOIN gov USING (label) JOIN first ON first.label = governor
), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank, ordinal, up, via) AS n FROM every) WHERE n = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, ordinal, up, label) AS position FROM once)
SELECT p.query_id, CAST(position AS INTEGER) AS position, {_PATH_OF.format('p.label')} AS source_path, coalesce(m.id, p.id) AS id, reason, {_PATH_OF.format('via')} AS via
FROM placed p LEFT JOIN m ON m.query_id = p.query_id AND m.label = p.label WHERE position <= 5"""
_RULES_SQL = f"""
SELECT 'plain-tags' AS rule_id, 'warning' AS severity, path, f AS failing, path || ' has odd tags: ' || f AS message FROM (SELECT path, p_brand AS f FROM (SELECT path, tags[1] AS p_brand FROM ({PART_SQL})))
UNION ALL SELECT 'tags-once', 'error', path, f, 'repeated: ' || f FROM (
  SELECT path, string_agg(t, ', ' ORDER BY pos) AS f FROM (
    SELECT path, t, min(pos) AS pos FROM (SELECT path, unnest(tags) AS t, generate_subscripts(tags, 1) AS pos FROM ({PART_SQL})) GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
UNION ALL SELECT 'known-notes', 'suggestion', path, string_agg(value, ', ' ORDER BY pos), 'no source for ' || string_agg(value, ', ' ORDER BY pos) || ' in ' || any_value(type) || ' {{nothing}}'
  FROM ({_NOTES_SQL}) WHERE value <> 'a' AND value <> 's' || (p_size % 9) GROUP BY path
UNION ALL SELECT 'has-index', 'warning', "index", NULL, 'add ' || "index" FROM ({_DIRECTORY_SQL}) WHERE NOT has_index"""

_SCENE_SQL = """
WITH n AS (SELECT count(*) AS n FROM supplier),
link AS (SELECT 's' || l_suppkey AS source, CASE WHEN l_returnflag = 'R' THEN '/attachments:p' || l_partkey ELSE 's' || ((l_suppkey + l_orderkey % 4) % (SELECT n FROM n)) END AS target, l_returnflag = 'R' AS asset FROM lineitem),
e AS (SELECT DISTINCT * FROM (SELECT source AS a, target AS b FROM link WHERE NOT asset AND source <> target UNION ALL SELECT target, source FROM link WHERE NOT asset AND source <> target)),
s AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_nationkey = 3),
one AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT * FROM s)),
two AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT * FROM one)),
near AS (SELECT node, min(d) AS distance FROM (SELECT node, 0 AS d FROM s UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY 1)
"""

ORACLES = {
    "q_scene_nodes": _SCENE_SQL + """
SELECT node, CAST(distance AS INTEGER) AS distance FROM near
UNION ALL SELECT target, CAST(min(distance) + 1 AS INTEGER) FROM link JOIN near ON source = node WHERE asset AND distance < 2 GROUP BY 1""",
    "q_scene_edges": _SCENE_SQL + """
SELECT source, target, 'concepts' AS layer, count(*) AS n FROM link JOIN near x ON source = x.node JOIN near y ON target = y.node WHERE NOT asset AND abs(x.distance - y.distance) = 1 GROUP BY ALL
UNION ALL SELECT source, target, 'attachments', count(*) FROM link JOIN near ON source = node WHERE asset AND distance < 2 GROUP BY ALL""",
    "q_snapshot": _SNAPSHOT_SQL,
    "q_index_search": f"SELECT query_id, rank, source_path, id, sim FROM ({_BEST_SQL})",
    "q_index_context": _CONTEXT_SQL,
    "q_index_notices": f"""
WITH m AS ({_BEST_SQL}), want AS (
  SELECT query_id, rank, -1 AS ordinal, label FROM m
  UNION ALL SELECT query_id, rank, o, CASE o WHEN 1 THEN (label + 5) % 10 ELSE (label + 3) % 10 END FROM m, (SELECT unnest([1, 2]) AS o) WHERE NOT (o = 2 AND label % 4 = 1)
), lost AS (
  SELECT query_id, rank, 2 AS ordinal, 'Unresolved relationship: gone.md' AS message, {_PATH_OF.format('label')} AS path FROM m WHERE label % 4 = 1
  UNION ALL SELECT query_id, rank, ordinal, 'Governing source excluded or has no passage: l0/d4.md', 'l0/d4.md' FROM want WHERE label = 6
), one AS (SELECT query_id, message, min((rank, ordinal)) AS pos, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM lost GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, message) AS INTEGER) AS position, message, paths FROM one""",
    "q_directory_facts": _DIRECTORY_SQL,
    "q_file_facts": f"SELECT suffix(path, '.md') AS markdown, CAST(length(name) AS INTEGER) AS length, count(*) AS n, min(name) AS first FROM (SELECT path, string_split(path, '/')[-1] AS name FROM {_FILES_SQL}) GROUP BY ALL",
    "q_footnotes": f"SELECT path, CAST(pos - 1 AS INTEGER) AS at, value, value <> 'b' AS referenced, value <> 's' || p_size AS defined, value = 'a' OR value = 's' || (p_size % 9) AS is_source_id FROM ({_NOTES_SQL})",
    "q_concept_facts": f"SELECT path, array_to_string(list_transform(tags, lambda t: t || '=' || len(list_filter(tags, lambda x: x = t))), ',') AS tags, 'part ' || p_size || '|notes' AS headings, p_size % 4 = 0 AS sibling_directory FROM ({PART_SQL})",
    "q_link_facts": f"""
SELECT source AS path, count(*) AS n_edges, count(*) FILTER (WHERE resolution <> 'external') AS n_internal, count(*) FILTER (WHERE prefix(raw_target, '/')) AS n_rooted,
  count(*) FILTER (WHERE relationship IS NOT NULL AND resolved_path IS NOT NULL) AS n_resolved FROM ({_EDGES_SQL}) GROUP BY 1""",
    "q_inbound_facts": f"SELECT resolved_path AS path, relationship, count(*) AS n, min(source) AS first_from FROM ({_EDGES_SQL}) WHERE resolution = 'resolvedConcept' AND relationship IS NOT NULL GROUP BY ALL",
    "q_typed_pairs": """
SELECT least(s, t) AS a, greatest(s, t) AS b, bool_or(s <= t) AS forward, bool_or(s > t) AS backward, count(*) AS n_links, bool_or(o <> 'bodyLink') AS typed,
  coalesce(array_to_string(list_sort(list(DISTINCT r) FILTER (WHERE r IS NOT NULL)), ','), '') AS labels, coalesce(array_to_string(list_sort(list(DISTINCT o) FILTER (WHERE r IS NULL)), ','), '') AS origins
FROM (SELECT 's' || l_suppkey AS s, 's' || ((l_suppkey + l_orderkey % 4) % 97) AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'relationships' ELSE 'bodyLink' END AS o, CASE WHEN l_linenumber % 4 = 0 THEN lower(l_returnflag) END AS r FROM lineitem)
WHERE s <> t GROUP BY ALL""",
    "q_link_layers": f"""
SELECT layer, '/' || layer || ':' || coalesce(resolved_path, raw_target) AS target, count(*) AS n
FROM (SELECT *, CASE resolution WHEN 'resolvedAsset' THEN 'attachments' WHEN 'external' THEN 'external' WHEN 'unresolved' THEN 'unresolved' END AS layer FROM (SELECT * REPLACE (CASE WHEN resolution = 'external' THEN NULL ELSE resolved_path END AS resolved_path) FROM ({_EDGES_SQL})))
WHERE layer IS NOT NULL GROUP BY ALL""",
    "q_rule_loop": _RULES_SQL,
    "q_findings_in_groups": f"""
SELECT rule_id AS key, ['error', 'warning', 'suggestion'][min(CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END)] AS worst, count(*) AS size, count(DISTINCT path) AS documents,
  CASE WHEN count(DISTINCT message) = 1 THEN min(message) END AS message FROM ({_RULES_SQL}) GROUP BY 1""",
    "q_weighted_means": f"SELECT query_group % 3 AS part, CAST(sum(queries) AS BIGINT) AS queries, " + ", ".join(f"round(sum({m} * queries) / sum(queries), 6) AS {m}" for m in ("recall", "ndcg", "mrr")) + f" FROM ({search_plans.ORACLES['q_metric_groups']}) GROUP BY 1",
    "q_tree_filter": f"""
WITH f AS (SELECT path FROM ({PART_SQL}) WHERE contains(lower(coalesce(title, '')), 'gear') OR contains(lower(path), 'gear') OR contains(lower(type), 'gear') OR len(list_filter(tags, lambda t: contains(lower(t), 'gear'))) > 0 OR path = 'brand-1/none/p0.md'),
d AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS node FROM f)
SELECT true AS is_file, count(*) AS n, min(path) AS first, max(path) AS last FROM f UNION ALL SELECT false, count(*), min(node), max(node) FROM d""",
    "q_type_tree": f"""
SELECT type, n_files, CAST(row_number() OVER (ORDER BY trim(type) = '', lower(type), type) AS INTEGER) AS position FROM (
  SELECT CASE WHEN p_size % 6 = 0 THEN '' WHEN p_size % 6 = 1 THEN lower(type) ELSE type END AS type, count(*) AS n_files FROM ({PART_SQL}) GROUP BY 1)""",
    "q_resource_labels": """
SELECT page_id, 'git · ' || sha1(url)[1:7] || CASE WHEN page_id % 2 = 0 THEN ' · p' || page_id || '.md' ELSE '' END AS pin, 'example.com/p' || page_id AS address, 'b' || page_id AS path, false AS url_is_pin FROM pages""",
}
