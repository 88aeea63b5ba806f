"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are runs of consecutive words.  A window occurs in a document
only if all its shingles do, so it is enough to join on one necessary shingle,
the rarest of the window.  Joined pairs then pass the length bound (the window
fits where the shingle stands) and the positional bound (the shingle's offset
puts the start inside the text) before the words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Fixed value: what the words of texts and items are.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Window keys, and bytes of their words and items, broadcast at once; a larger benchmark is joined in blocks.
MAX_BROADCAST_KEYS, MAX_BROADCAST_BYTES = 200_000, 64 << 20


def words_of(text: Column) -> Column:
    """Lower-cased (A to Z) words of a text; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of all items: words, n (their number) and items (ids as strings).

    Items of fewer words than ``window``, but not none, are one window; null
    texts and texts without words give none.
    """
    w = F.col("words")
    starts = F.when(F.size(w) >= window, F.sequence(F.lit(0), F.size(w) - window)).when(F.size(w) > 0, F.array(F.lit(0)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at") + 1, window).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("n", F.size("words"))
    )


def prefix_keys(windows: DataFrame) -> DataFrame:
    """One necessary shingle for each window: key (long), width, offset, and the window.

    Shingles are ordered by the number of distinct windows that hold them,
    rarest first, then by hash.  Windows of fewer than ``SHINGLE`` words are
    keyed by one word.
    """
    width = F.when(F.col("n") >= SHINGLE, SHINGLE).otherwise(1)
    places = windows.withColumn("width", width).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))))
    wide = F.when(F.col("width") == SHINGLE, _shingle(F.col("words"), F.col("offset"), SHINGLE)).otherwise(_shingle(F.col("words"), F.col("offset"), 1))
    placed = places.withColumn("key", wide)
    rarity = placed.groupBy("width", "key").agg(F.count_distinct("words").alias("df"))
    best = placed.join(rarity, ["width", "key"]).groupBy("words", "n", "width").agg(F.min(F.struct("df", "key", "offset")).alias("b"), F.first("items").alias("items"))
    return best.select(F.col("b.key").alias("key"), "width", F.col("b.offset").alias("offset"), F.col("words").alias("window"), "n", "items")


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """doc_id, text_hash, n_words, spans (start, n), items and n_rows of every distinct document row.

    ``spans`` are the places where windows occur and ``items`` the ids, as
    strings, of their items.  Documents without a word have none.  Rows that
    repeat a doc_id and its text are one result row with ``n_rows`` above 1;
    null doc_ids are a value like others.  An empty benchmark hits nothing.  An
    item of null id marks hits, but is no item by name.
    """
    keys = materialise(prefix_keys(item_windows(benchmark, window)), "window-keys")
    held = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("window") + F.size("items"))
    sizes = {r.width: max(-(-r.n // max_keys), -(-r.bytes // MAX_BROADCAST_BYTES)) for r in keys.groupBy("width").agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).collect()}
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # place -1 stands for the document itself and goes through every join once
    places = F.when(F.col("n_words") > 0, F.sequence(F.lit(-1), F.col("n_words") - 1)).otherwise(F.array(F.lit(-1)))
    found = None
    passes = [(w, b, sizes[w]) for w in sorted(sizes, reverse=True) for b in range(sizes[w])] or [(SHINGLE, 0, 1)]
    for number, (width, block, blocks) in enumerate(passes):
        some = keys.filter((F.col("width") == width) & (F.pmod(F.col("key"), F.lit(blocks)) == block)).drop("width")
        placed = docs.withColumn("at", F.explode_outer(places)).withColumn("here", F.when(F.col("at") >= 0, _shingle(F.col("words"), F.col("at"), width)))
        joined = placed.join(F.broadcast(some), F.col("here") == F.col("key"), "left")
        start = F.col("at") - F.col("offset")
        fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
        same = F.when(fits, F.slice("words", start + 1, F.col("n")) == F.col("window"))
        span = F.when(same, F.struct(start.alias("start"), F.col("n").alias("n")))
        rows = joined.filter(same | (F.col("at") == -1) if not number else same).select("doc_id", "text_hash", "n_words", span.alias("span"), F.when(same, F.col("items")).alias("items"), (F.col("at") == -1).cast("long").alias("own"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum("own").alias("n_rows"),
    )


def contamination_report(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated: a row for each row of ``documents``."""
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    return (
        find_contamination(documents, benchmark, window)
        .withColumn("n_hit", F.size(covered).cast("long"))
        .withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("n_rows").cast("int"))))
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_broadcast: int = 500_000) -> DataFrame:
    """The rows of ``documents``, with all their columns, in which no window of the benchmark occurs.

    Contaminated rows are named by doc_id and a hash of the text.  Their number
    is counted: up to ``max_broadcast`` they are broadcast, beyond that the
    anti-join shuffles.
    """
    bad = materialise(find_contamination(documents, benchmark, window).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "contaminated")
    named = F.broadcast(bad) if bad.count() <= max_broadcast else bad
    return documents.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")
