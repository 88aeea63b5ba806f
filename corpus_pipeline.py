"""A corpus pipeline: five stages, each an operator of ``lodestone.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  ``run`` writes what a stage returns to the shared folder and
reads it back as the next one's input.

All stages but the last return the columns of ``documents`` and leave others
out.  Null doc_ids, null and empty texts, repeated rows and empty tables go
through: the classifier scores a text without words like any other, rows without
words have no near duplicates and no benchmark passages, and nothing in them is
private.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, feistel_pii, piece_codec, pu_quality, signature_join
from lodestone.llm.common import materialise, table
from lodestone.llm.queries import pii_key, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that a Python worker is handed at once: some 3 MB of text.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what travels between Spark and Python at once.

    Spark reads the setting when a stage's result is written, so it stays set in
    the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the positive-unlabelled classifier takes for good."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return pu_quality.keep_good(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five words a shingle, similarity of 0.8 or more."""
    small_batches(spark)
    return signature_join.keep_one(docs.select(*COLUMNS), shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=10)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced under the session's key; n_chars is that of the new text (null stays null)."""
    from pyspark.sql import functions as F

    out = feistel_pii.pseudonymise(docs.select(*COLUMNS), pii_key(spark), counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, SentencePiece ids and the checks on them."""
    small_batches(spark)
    return piece_codec.encode_pieces(docs.select(*COLUMNS), vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", pseudonyms),
    ("SentencePiece encoding and decoding", pieces),
]

#: A learnt classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{number}")
    return docs
