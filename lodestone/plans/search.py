"""Queries over vectors, passages, index updates and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators import evaluation as ev
from ..operators import search as se
from ..operators import sync as sy
from ..session import table
from .common import LINES_SQL, line_chunks


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter("id % 20 = 0")


def q_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every 20th vector, exactly."""
    v = _vectors(spark, sf_dir)
    return se.nearest(v, _queries(v), 5)


def q_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility before scoring: only vectors of even label."""
    v = _vectors(spark, sf_dir)
    return se.nearest(v.filter("label % 2 = 0"), _queries(v), 5)


def q_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to its predecessor, as a Column expression."""
    v = _vectors(spark, sf_dir)
    before = v.select((F.col("id") + 1).alias("id"), F.col("vector").alias("other"))
    return v.join(before, "id").select("id", F.round(cosine(F.col("vector"), F.col("other")), 6).alias("sim"))


def _per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return se.nearest_per_document(v, _queries(v), "label")


def q_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of each label, taken as its document, over the whole ranking."""
    return _per_label(spark, sf_dir).select("query_id", "label", "id", "sim")


def q_cross_bundle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of three bundles, of which each is searched for its own ten."""
    v = _vectors(spark, sf_dir)
    found = [se.nearest(v.filter(F.col("label") % 3 == b), _queries(v), 10).withColumn("bundle", F.lit(f"b{b}")) for b in range(3)]
    hits = found[0].unionByName(found[1]).unionByName(found[2]).join(v.select("id", F.concat(F.lit("d"), F.col("label").cast("string")).alias("source_path")), "id")
    return se.merge_bundles(hits, 10).select("query_id", "rank", "bundle", "source_path", "id", "sim")


def q_rerank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rerank 50 candidates by whether their label is the query's, and keep five."""
    v = _vectors(spark, sf_dir)
    asked = v.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    scored = se.nearest(v, _queries(v), 50).join(v.select("id", "label"), "id").join(asked, "query_id")
    return se.rerank(scored, (F.col("label") == F.col("query_label")).cast("int"), 5).select("query_id", "id", "score", "new_rank")


def q_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a stored vector of their id."""
    eligible = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return se.uncovered(eligible, _vectors(spark, sf_dir).withColumnRenamed("id", "chunk_id"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: single turns, each turn with the next, and the whole."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_path"), "turn").distinct()
    one = turns.select("source_path", F.col("turn").alias("line_start"), F.col("turn").alias("line_end"), F.lit("t").alias("k"))
    two = turns.select("source_path", F.col("turn").alias("line_start"), (F.col("turn") + 1).alias("line_end"), F.lit("p").alias("k"))
    all_ = turns.groupBy("source_path").agg(F.min("turn").alias("line_start"), F.max("turn").alias("line_end")).withColumn("k", F.lit("w"))
    spans = one.unionByName(two).unionByName(all_)
    return spans.withColumn("chunk_id", F.concat_ws(":", "source_path", "k", F.col("line_start").cast("string"), F.col("line_end").cast("string")))


_SPANS_SQL = """
SELECT *, source_path || ':' || k || ':' || line_start || ':' || line_end AS chunk_id FROM (
  SELECT DISTINCT 'c' || conv_id AS source_path, turn AS line_start, turn AS line_end, 't' AS k FROM conversations
  UNION ALL SELECT DISTINCT 'c' || conv_id, turn, turn + 1, 'p' FROM conversations
  UNION ALL SELECT 'c' || conv_id, min(turn), max(turn), 'w' FROM conversations GROUP BY 1)
"""


def q_parent_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.enclosing_parents(_spans(spark, sf_dir))


def q_parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on single turns, replaced by the passage around them; each context once."""
    spans = _spans(spark, sf_dir)
    hits = spans.filter("k = 't'").select(F.col("line_start").alias("query_id"), "chunk_id", F.row_number().over(Window.partitionBy("line_start").orderBy("chunk_id")).alias("rank"))
    return se.expand_to_parents(hits, se.enclosing_parents(spans))


def q_parent_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items name their order as parent symbol; orders are the parents, in files by customer."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("source_path"), F.col("o_orderkey"))
    parents = o.select("source_path", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"), (F.col("o_orderkey") % 9).cast("string").alias("symbol"), F.lit(None).cast("string").alias("parent_symbol"), F.col("o_orderkey").alias("line_start"), (F.col("o_orderkey") + F.col("o_orderkey") % 5).alias("line_end"))
    items = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    children = items.select("source_path", F.concat_ws("-", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.lit("").alias("symbol"), (F.col("l_partkey") % 9).cast("string").alias("parent_symbol"), F.col("l_orderkey").alias("line_start"), F.col("l_orderkey").alias("line_end"))
    return se.symbol_parents(parents.unionByName(children))


def q_context_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best labels of each query, and up to two passages of labels that those link to."""
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    best = _per_label(spark, sf_dir).withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("query_id", F.col("label").alias("document"), "rank")
    labels = _vectors(spark, sf_dir).groupBy("label").agg(F.min("id").alias("passage_id"))
    edges = labels.select(F.col("label").alias("source"), F.explode(F.array(F.lit(1), F.lit(4))).alias("ordinal")).withColumn("target", (F.col("source") + F.col("ordinal")) % 10)
    return se.expand_links(best, edges, labels.select(F.col("label").alias("document"), "passage_id"), 2)


def q_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are the first with their text."""
    d = table(spark, sf_dir, "documents").select("doc_id", sy.input_hash(F.col("text")).alias("input_hash"))
    return sy.first_seen(d, "input_hash", "doc_id")


def q_id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers used as ids come with many texts: what an ingest refuses."""
    return sy.conflicting_ids(table(spark, sf_dir, "conversations"), "turn", "text")


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 10 <> 0").select("doc_id", sy.input_hash(F.col("text")).alias("input_hash"), F.col("source").alias("meta_hash"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    meta = F.when(F.col("doc_id") % 5 == 0, "moved").otherwise(F.col("source"))
    new = d.filter("doc_id % 11 <> 0").select("doc_id", sy.input_hash(text).alias("input_hash"), meta.alias("meta_hash"))
    return old, new


def q_incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.plan_update(*_generations(spark, sf_dir), "doc_id")


def q_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.plan_update(*_generations(spark, sf_dir), "doc_id").groupBy("action").agg(F.count("*").alias("n"))


def q_freshness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (x.select(F.col("doc_id").cast("string").alias("path"), F.col("input_hash").alias("digest")) for x in _generations(spark, sf_dir))
    return sy.changed_paths(old, new)


def q_index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.index_state(q_freshness_diff(spark, sf_dir), exists=True, same_configuration=True)


def q_manifest_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", sy.input_hash(F.col("text")).alias("digest"))
    return sy.fingerprints(d, "source", "doc_id", "digest")


def q_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of all lines of all documents."""
    return line_chunks(spark, sf_dir).select(tx.chunk_id(*map(F.col, ("source_path", "line_start", "line_end", "chunk_type", "content"))).alias("chunk_id"), "source_path", "line_start")


def q_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking, qrels = _judged(spark, sf_dir)
    return ev.query_metrics(ranking, qrels, 10)


def _judged(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Ranking by cosine; vectors of the query's label are relevant, those of even id doubly."""
    v = _vectors(spark, sf_dir)
    q = _queries(v).select(F.col("id").alias("query_id"), "label")
    qrels = q.join(v.select("id", "label"), "label").filter("id <> query_id").select("query_id", "id", (2 - F.col("id") % 2).cast("int").alias("relevance"))
    return se.nearest(v, _queries(v), k), qrels


def q_metric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking, qrels = _judged(spark, sf_dir)
    groups = _vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("label").alias("query_group"))
    return ev.mean_metrics(ev.query_metrics(ranking, qrels, 10).join(groups, "query_id"), "query_group")


def q_regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at 10 as the baseline of metrics at 3."""
    ranking, qrels = _judged(spark, sf_dir)
    groups = _vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.concat(F.lit("g"), (F.col("label") % 4).cast("string")).alias("name"))
    run = lambda k: ev.mean_metrics(ev.query_metrics(ranking, qrels, k).join(groups, "query_id"), "name")
    return ev.regressions(run(10), run(3))


def q_run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of all vectors against ten nearest of those of even id."""
    v = _vectors(spark, sf_dir)
    return ev.run_overlap(se.nearest(v, _queries(v), 10), se.nearest(v.filter("id % 2 = 0"), _queries(v), 10))


def q_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


def q_span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    return ev.span_overlaps(spans.filter("k <> 't'"), spans.filter("k = 'p'")).filter("left_id <> right_id")


QUERIES = {
    f.__name__: f
    for f in (
        q_knn_topk, q_knn_filtered, q_cosine_pairs, q_best_passage, q_cross_bundle_topk, q_rerank_window, q_uncovered, q_parent_range, q_parent_context,
        q_parent_symbol, q_context_expansion, q_ingest_dedupe, q_id_conflicts, q_incremental_sync, q_sync_counts, q_freshness_diff, q_index_state,
        q_manifest_fingerprint, q_chunk_ids, q_retrieval_metrics, q_metric_groups, q_regression_gate, q_run_overlap, q_latency_percentiles, q_span_overlap,
    )
}


def _knn_sql(k: int, where: str = "true") -> str:
    return f"""
SELECT query_id, id, sim, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS sim
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND {where}))
WHERE rank <= {k}"""


_SCORED_SQL = f"SELECT s.*, e.label FROM ({_knn_sql(50)}) s JOIN embeddings e ON s.id = e.vec_id"
_BUNDLES_SQL = " UNION ALL ".join(f"SELECT s.*, 'b{b}' AS bundle, 'd' || e.label AS source_path FROM ({_knn_sql(10, f'v.label % 3 = {b}')}) s JOIN embeddings e ON s.id = e.vec_id" for b in range(3))
_BEST_SQL = """
SELECT query_id, label, id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, id) AS n FROM (
    SELECT q.vec_id AS query_id, v.label, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS sim
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id))
WHERE n = 1"""
_GEN_SQL = """
old AS (SELECT doc_id, sha256(text) AS input_hash, source AS meta FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS input_hash, CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE source END AS meta FROM documents WHERE doc_id % 11 <> 0)"""
_SYNC_SQL = f"""
WITH {_GEN_SQL}
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'remove' WHEN o.doc_id IS NULL OR o.input_hash <> n.input_hash THEN 'embed' WHEN o.meta <> n.meta THEN 'write' ELSE 'keep' END AS action
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"""
_FRESH_SQL = f"""
WITH {_GEN_SQL}
SELECT CAST(coalesce(o.doc_id, n.doc_id) AS VARCHAR) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id WHERE o.input_hash IS DISTINCT FROM n.input_hash"""


def _metrics_sql(k: int) -> str:
    return f"""
WITH qrels AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, 2 - v.vec_id % 2 AS relevance FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), gained AS (
  SELECT query_id, count(*) AS found, sum(relevance / log2(rank + 1.0)) AS dcg, min(rank) AS first FROM ({_knn_sql(10)}) JOIN qrels USING (query_id, id) WHERE rank <= {k} GROUP BY 1
), ideal AS (
  SELECT query_id, count(*) AS relevant, sum(CASE WHEN n <= {k} THEN relevance / log2(n + 1.0) END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS n FROM qrels) GROUP BY 1
)
SELECT query_id, round(coalesce(found / relevant, 0), 9) AS recall, round(coalesce(dcg / idcg, 0), 9) AS ndcg, round(coalesce(1.0 / first, 0), 9) AS mrr FROM ideal LEFT JOIN gained USING (query_id)"""


_PARENT_SQL = f"""
SELECT chunk_id, parent_id FROM (
  SELECT c.chunk_id, p.chunk_id AS parent_id, row_number() OVER (PARTITION BY c.chunk_id ORDER BY p.line_end - p.line_start, p.line_start DESC, p.chunk_id) AS n
  FROM ({_SPANS_SQL}) c JOIN ({_SPANS_SQL}) p ON c.source_path = p.source_path AND p.line_start <= c.line_start AND p.line_end >= c.line_end AND p.line_end - p.line_start > c.line_end - c.line_start)
WHERE n = 1"""


def _gate_side(k: int, label: str) -> str:
    return f"""
SELECT name, metric, value AS {label} FROM (
  SELECT 'g' || (label % 4) AS name, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM ({_metrics_sql(k)}) JOIN embeddings ON vec_id = query_id GROUP BY 1)
UNPIVOT (value FOR metric IN (recall, ndcg))"""


ORACLES = {
    "q_knn_topk": _knn_sql(5),
    "q_knn_filtered": _knn_sql(5, "v.label % 2 = 0"),
    "q_cosine_pairs": "SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1",
    "q_best_passage": _BEST_SQL,
    "q_cross_bundle_topk": f"SELECT query_id, CAST(n AS INTEGER) AS rank, bundle, source_path, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, bundle, source_path, id) AS n FROM ({_BUNDLES_SQL})) WHERE n <= 10",
    "q_rerank_window": f"SELECT query_id, id, score, CAST(n AS INTEGER) AS new_rank FROM (SELECT s.query_id, s.id, CAST(s.label = q.label AS INTEGER) AS score, row_number() OVER (PARTITION BY s.query_id ORDER BY (s.label = q.label) DESC, rank) AS n FROM ({_SCORED_SQL}) s JOIN embeddings q ON s.query_id = q.vec_id) WHERE n <= 5",
    "q_uncovered": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "q_parent_range": _PARENT_SQL,
    "q_parent_context": f"""
SELECT query_id, context_id, rank, expanded FROM (
  SELECT query_id, coalesce(parent_id, chunk_id) AS context_id, CAST(rank AS INTEGER) AS rank, parent_id IS NOT NULL AS expanded, row_number() OVER (PARTITION BY query_id, coalesce(parent_id, chunk_id) ORDER BY rank) AS n
  FROM (SELECT line_start AS query_id, chunk_id, row_number() OVER (PARTITION BY line_start ORDER BY chunk_id) AS rank FROM ({_SPANS_SQL}) WHERE k = 't') LEFT JOIN ({_PARENT_SQL}) USING (chunk_id))
WHERE n = 1""",
    "q_parent_symbol": """
WITH children AS (
  SELECT DISTINCT o_custkey AS f, 'l-' || l_orderkey || '-' || l_linenumber AS chunk_id, l_partkey % 9 AS symbol, l_orderkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
SELECT chunk_id, parent_id FROM (
  SELECT chunk_id, 'o' || o_orderkey AS parent_id, row_number() OVER (PARTITION BY chunk_id ORDER BY o_orderkey > s, abs(o_orderkey - s), o_orderkey % 5, 'o' || o_orderkey) AS n
  FROM children JOIN orders ON o_custkey = f AND o_orderkey % 9 = symbol) WHERE n = 1""",
    "q_context_expansion": f"""
WITH best AS ({_BEST_SQL}), matched AS (
  SELECT query_id, label AS document, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM best) WHERE rank <= 3
), labels AS (SELECT label, min(vec_id) AS passage_id FROM embeddings GROUP BY 1),
hop AS (
  SELECT query_id, rank, ordinal, document AS via, (document + ordinal) % 10 AS target FROM matched, (SELECT unnest([1, 4]) AS ordinal)
), once AS (
  SELECT * FROM (SELECT h.*, passage_id, row_number() OVER (PARTITION BY query_id, target ORDER BY rank, ordinal, via) AS n
    FROM hop h JOIN labels l ON h.target = l.label WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.query_id = h.query_id AND m.document = h.target)) WHERE n = 1
)
SELECT query_id, CAST(position AS INTEGER) AS position, via, target AS document, passage_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, ordinal, via, target) AS position FROM once) WHERE position <= 2""",
    "q_ingest_dedupe": "SELECT doc_id, sha256(text) AS input_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_first FROM documents",
    "q_id_conflicts": "SELECT turn, count(DISTINCT text) AS n_texts FROM conversations GROUP BY 1 HAVING count(DISTINCT text) > 1",
    "q_incremental_sync": _SYNC_SQL,
    "q_sync_counts": f"SELECT action, count(*) AS n FROM ({_SYNC_SQL}) GROUP BY 1",
    "q_freshness_diff": _FRESH_SQL,
    "q_index_state": f"SELECT count(*) AS changed, CASE WHEN count(*) > 0 THEN 'stale' ELSE 'current' END AS state FROM ({_FRESH_SQL})",
    "q_manifest_fingerprint": """
WITH lines AS (
  SELECT source, sha256(CAST(doc_id AS VARCHAR))[1:4] AS bucket, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text))) AS h FROM documents GROUP BY 1, 2
), upper AS (SELECT source, bucket[1:2] AS top, sum(n) AS n, sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)) AS h FROM lines GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n_files, sha256(string_agg(top || ':' || h, chr(10) ORDER BY top)) AS fingerprint FROM upper GROUP BY 1""",
    "q_chunk_ids": f"SELECT sha1(source_path || '|' || line_start || '|' || line_end || '|line|' || sha1(content)) AS chunk_id, source_path, CAST(line_start AS INTEGER) AS line_start FROM ({LINES_SQL})",
    "q_retrieval_metrics": _metrics_sql(10),
    "q_metric_groups": f"SELECT label AS query_group, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM ({_metrics_sql(10)}) JOIN embeddings ON vec_id = query_id GROUP BY 1",
    "q_regression_gate": f"SELECT name, metric, baseline, current, round(baseline - current, 6) AS drop, round(baseline - current, 6) <= CASE metric WHEN 'recall' THEN 0.05 ELSE 0.03 END AS passed FROM ({_gate_side(10, 'baseline')}) JOIN ({_gate_side(3, 'current')}) USING (name, metric)",
    "q_run_overlap": f"""
SELECT query_id, count(l.sim + r.sim) AS shared, round(count(l.sim + r.sim) / count(*), 9) AS jaccard, round(avg(abs(l.sim - r.sim)), 6) AS mean_delta
FROM ({_knn_sql(10)}) l FULL JOIN ({_knn_sql(10, "v.vec_id % 2 = 0")}) r USING (query_id, id) GROUP BY 1""",
    "q_latency_percentiles": "SELECT event_type, count(*) AS n, " + ", ".join(f"quantile_disc(value, {q}) AS p{p}, list_sort(list(value))[least(CAST(floor(count(*) * {q}) AS BIGINT) + 1, count(*))] AS i{p}" for q, p in ((0.5, 50), (0.95, 95))) + " FROM events GROUP BY 1",
    "q_span_overlap": f"SELECT a.source_path, a.chunk_id AS left_id, b.chunk_id AS right_id, least(a.line_end, b.line_end) - greatest(a.line_start, b.line_start) + 1 AS overlap FROM ({_SPANS_SQL}) a JOIN ({_SPANS_SQL}) b ON a.source_path = b.source_path AND a.k <> 't' AND b.k = 'p' AND a.chunk_id <> b.chunk_id AND least(a.line_end, b.line_end) >= greatest(a.line_start, b.line_start)",
}
