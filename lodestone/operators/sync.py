"""Content hashes: duplicate input, incremental index updates, freshness and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def input_hash(text: Column) -> Column:
    """SHA-256 of what is embedded."""
    return F.sha2(text, 256)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with ``is_first``: whether a row has the smallest ``order`` of its key.

    The smallest is found by a combined aggregate and joined back by key and
    order, so that a key that very many rows share is not one task's work.
    """
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col(order) == F.col("__first"))
    return rows.join(first, same, "left").withColumn("is_first", F.col("__first").isNotNull()).drop("__key", "__first")


def conflicting_ids(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys that come with more than one text, and how many; an ingest must refuse them."""
    return rows.groupBy(key).agg(F.count_distinct(F.sha2(text, 256)).alias("n_texts")).filter("n_texts > 1")


def refuse_conflicts(rows: DataFrame, key: str, text: str) -> None:
    """Raise ValueError if a key comes with more than one text."""
    found = conflicting_ids(rows, key, text).limit(5).collect()
    if found:
        raise ValueError(f"ids with several texts: {[r[key] for r in found]}")


def refuse_repeats(rows: DataFrame, key: str) -> None:
    """Raise ValueError if a key stands in more than one row, as no id of a bundle, passage or run may."""
    found = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    if found:
        raise ValueError(f"ids that repeat: {[r[key] for r in found]}")


def plan_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and action to bring an index from ``old`` to ``new`` (key, input_hash, meta_hash).

    ``embed``: new, or its input changed.  ``write``: only its metadata changed,
    so the stored vector stays.  ``remove``: gone.  ``keep``: as it was.
    """
    a = old.select(F.col(key), F.col("input_hash").alias("a_in"), F.col("meta_hash").alias("a_meta"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key), F.col("input_hash").alias("b_in"), F.col("meta_hash").alias("b_meta"), F.lit(True).alias("in_new"))
    action = (
        F.when(F.col("in_new").isNull(), "remove")
        .when(F.col("in_old").isNull() | ~F.col("a_in").eqNullSafe(F.col("b_in")), "embed")
        .when(~F.col("a_meta").eqNullSafe(F.col("b_meta")), "write")
        .otherwise("keep")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def changed_paths(saved: DataFrame, live: DataFrame) -> DataFrame:
    """path and change (added, removed, modified) between two inventories (path, digest)."""
    a, b = saved.select("path", F.col("digest").alias("a")), live.select("path", F.col("digest").alias("b"))
    both = a.join(b, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


def index_state(changes: DataFrame, exists: bool, same_configuration: bool, refreshing: bool = False) -> DataFrame:
    """One row: refreshing, missing, incompatible, stale or current, and the number of changed paths."""
    n = F.count("*")
    state = F.lit("refreshing") if refreshing else F.lit("missing") if not exists else F.lit("incompatible") if not same_configuration else F.when(n > 0, "stale").otherwise("current")
    return changes.agg(n.alias("changed"), state.alias("state"))


def fingerprints(files: DataFrame, group: str, key: str, digest: str) -> DataFrame:
    """group, n_files and fingerprint: SHA-256 over a group's ``key:digest`` lines in order of key.

    Lines are hashed in buckets of the key first, buckets of buckets next, and
    those hashes together, so that a task holds a 65536th of a large group.
    """
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.col(digest))
    joined = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "\n"), 256)
    bucket = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 4)
    lines = files.groupBy(group, bucket.alias("bucket")).agg(F.count("*").alias("n"), joined(line).alias("h"))
    upper = lines.groupBy(group, F.substring("bucket", 1, 2).alias("top")).agg(F.sum("n").alias("n"), joined(F.concat("bucket", F.lit(":"), "h")).alias("h"))
    return upper.groupBy(group).agg(F.sum("n").alias("n_files"), joined(F.concat("top", F.lit(":"), "h")).alias("fingerprint"))
