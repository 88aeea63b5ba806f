"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bayes_minhash, chat_snapshots, decontamination, feistel_pii, histogram_shards, line_cleaning, merkle_manifest, piece_codec, pu_quality, signature_join, source_divergence, token_frames, token_rollups
from .common import materialise, new_path, table

#: Demonstration key: anyone can turn its pseudonyms back.
PII_KEY = "lodestone-demo-key"
#: The session's setting that names a deployment's own secret.
PII_KEY_SETTING = "spark.lodestone.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The secret of the session's setting; where it is unset the demonstration key, with a warning."""
    found = spark.conf.get(PII_KEY_SETTING, None)
    if not found:
        warnings.warn(f"{PII_KEY_SETTING} is unset: pseudonyms of the demonstration key can be turned back", stacklevel=2)
    return found or PII_KEY


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cleaning.line_first_cleaning(table(spark, sf_dir, "documents"), with_text=False)


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest every document, delete exact copies, revise counts without repeated lines, and replay the first batch."""
    documents = table(spark, sf_dir, "documents").withColumn("text_md5", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    first = documents.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))
    counted = materialise(token_rollups.count_tokens(documents, vocabulary("word_bpe_49k.json")), "token-counts")
    version = F.lit("word_bpe_49k/1")
    rows = counted.select("doc_id", "source", "lang", version.alias("tokenizer"), F.lit("insert").alias("op"), "tokens")
    copies = rows.join(first.select("doc_id"), "doc_id", "left_anti").withColumn("op", F.lit("delete"))
    shorter = counted.filter("clean_tokens <> tokens").select("doc_id", "source", "lang", version.alias("tokenizer"), F.lit("revise").alias("op"), F.col("clean_tokens").alias("tokens"))
    rollups = token_rollups.TokenRollups(spark, new_path(spark, "token-rollups"))
    rollups.commit("000-ingest", rows)
    rollups.commit("001-copies", copies)
    rollups.commit("002-lines", shorter.join(first.select("doc_id"), "doc_id", "left_semi"))
    rollups.commit("000-ingest", rows)
    return rollups.totals()


def op5_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pu_quality.score_documents(documents, pu_quality.train(documents, table(spark, sf_dir, "labels")), threshold=0.3)


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.token_frames(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.chat_texts(table(spark, sf_dir, "conversations"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what tampering with some of them shows."""
    return merkle_manifest.audited(table(spark, sf_dir, "documents"), fanout=2)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of each language against the other sources and the language."""
    return source_divergence.divergences(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by two-word shingles at 0.8."""
    return bayes_minhash.minhash_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_histogram_shards, op2_feistel_pii, op3_line_cleaning, op4_token_rollups, op5_signature_join,
        op6_pu_quality, op7_token_frames, op8_decontamination, op9_piece_codec, op10_chat_snapshots,
        op11_merkle_manifest, op12_source_divergence, op13_bayes_minhash, pipeline,
    )
}
