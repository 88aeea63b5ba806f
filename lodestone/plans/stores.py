"""Queries over stored indexes: synchronization and search by cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pruned_search as ps
from ..operators.synchronize import synchronize
from ..session import new_folder, table
from ..sources.buckets import BucketStore
from .search import ORACLES as SEARCH_ORACLES
from .search import _queries, _vectors


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as passages before and after: sources leave, ids move, texts and titles change."""
    d = table(spark, sf_dir, "documents")
    named = lambda letter: F.concat(F.lit(letter), F.col("doc_id").cast("string"))
    common = (F.lit("b").alias("bundle_id"), F.col("source").alias("source_path"))
    old = d.filter("source <> 'src0'").select(named("d").alias("chunk_id"), *common, F.col("lang").alias("title"), F.col("text").alias("input"))
    new = d.filter("lang <> 'es'").select(
        F.when(F.col("source") == "src4", named("m")).otherwise(named("d")).alias("chunk_id"), *common,
        F.when(F.col("source") == "src3", F.concat(F.lit("new "), "lang")).otherwise(F.col("lang")).alias("title"),
        F.when(F.col("source") == "src1", F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("input"),
    )
    return old, new


def q_synchronize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three synchronizations of all documents do: a first one, one after many changes, and one without."""
    store = BucketStore(spark, new_folder(spark, "synchronized"), n_buckets=32)
    old, new = _versions(spark, sf_dir)
    done = [synchronize(store, rows, "b") for rows in (old, new, new)]
    rows = [(k, x.embedded, x.encoded, x.reused, x.written, x.removed, x.entry.rows("chunks"), x.entry.rows("vectors")) for k, x in enumerate(done, 1)]
    store.forget()
    return spark.createDataFrame(rows, "step int, embedded long, encoded long, reused long, written long, removed long, chunks long, vectors long")


def q_knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every 20th vector, by cells."""
    v = _vectors(spark, sf_dir).select("id", "vector")
    return ps.nearest_pruned(ps.build(v, 64), _queries(v), 5).found


QUERIES = {f.__name__: f for f in (q_synchronize_counts, q_knn_pruned)}

ORACLES = {
    "q_knn_pruned": SEARCH_ORACLES["q_knn_topk"],
    "q_synchronize_counts": """
WITH old AS (
  SELECT 'd' || doc_id AS id, source, lang AS title, text AS input FROM documents WHERE source <> 'src0'
), new AS (
  SELECT CASE WHEN source = 'src4' THEN 'm' ELSE 'd' END || doc_id AS id, source, CASE WHEN source = 'src3' THEN 'new ' || lang ELSE lang END AS title,
    CASE WHEN source = 'src1' THEN text || ' more' ELSE text END AS input
  FROM documents WHERE lang <> 'es'
), step AS (
  SELECT n.input, n.input IS DISTINCT FROM o.input AS embeds, n.input IN (SELECT input FROM old) AS known,
    o.id IS NULL OR (n.source, n.title, n.input) IS DISTINCT FROM (o.source, o.title, o.input) AS writes
  FROM new n LEFT JOIN old o USING (id)
)
SELECT 1 AS step, count(*) AS embedded, count(DISTINCT input) AS encoded, 0 AS reused, count(*) AS written, 0 AS removed, count(*) AS chunks, count(*) AS vectors FROM old
UNION ALL
SELECT 2, count(*) FILTER (WHERE embeds AND NOT known), count(DISTINCT input) FILTER (WHERE embeds AND NOT known), count(*) FILTER (WHERE embeds AND known), count(*) FILTER (WHERE writes),
  (SELECT count(*) FROM old WHERE id NOT IN (SELECT id FROM new)), count(*), count(*) FROM step
UNION ALL
SELECT 3, 0, 0, 0, 0, 0, count(*), count(*) FROM new
""",
}
