"""Queries, relevance judgments and query groups from JSON files of one object each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("query_id", "v"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id and text."""
    return _pairs(spark, path, "string").withColumnRenamed("v", "text")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """query_id and query_group."""
    return _pairs(spark, path, "string").withColumnRenamed("v", "query_group")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, id and relevance."""
    return _pairs(spark, path, "map<string,int>").select("query_id", F.explode("v").alias("id", "relevance"))


def check_groups(queries: DataFrame, groups: DataFrame) -> None:
    """Refuse groups that leave a query out or name one that is not there."""
    missing = queries.join(groups, "query_id", "left_anti").limit(5).collect()
    unknown = groups.join(queries, "query_id", "left_anti").limit(5).collect()
    if missing or unknown:
        raise ValueError(f"queries without a group: {[r.query_id for r in missing]}; groups of unknown queries: {[r.query_id for r in unknown]}")
