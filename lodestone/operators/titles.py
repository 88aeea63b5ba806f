"""Title search, snippets and file trees."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text, implied_directories

#: Scores of how a text matches, and what a whole-query match adds.
EXACT, PREFIX, WORD_START, INSIDE, WHOLE_QUERY = 1000, 900, 700, 500, 200
ID_WEIGHT, TAG_WEIGHT = 0.6, 0.7


def field_score(text: Column, needle: str) -> Column:
    """Score of a lower-cased text for one lower-cased needle; 0 where it is not contained."""
    word_start = f"(^|[^a-z0-9]){re.escape(needle)}"
    return (
        F.when(text.isNull() | (text == ""), 0)
        .when(text == needle, EXACT)
        .when(text.startswith(needle), PREFIX)
        .when(text.rlike(word_start), WORD_START)
        .when(text.contains(needle), INSIDE)
        .otherwise(0)
    )


def title_matches(concepts: DataFrame, query: str) -> DataFrame:
    """id, title and score of the documents that match all words of ``query``.

    The whole query in the title wins; else the mean over words of the best of
    title, id and tags.  Letters scattered over the title do not count.
    """
    words = query.lower().split()
    if not words:
        return concepts.select("id", "title", F.lit(0).alias("score")).filter("false")
    title, id_ = F.lower("title"), F.lower("id")
    whole = field_score(title, " ".join(words))

    def best(word: str) -> Column:
        tags = F.coalesce(F.array_max(F.transform("tags", lambda t: field_score(F.lower(t), word))), F.lit(0))
        return F.greatest(field_score(title, word), F.round(field_score(id_, word) * ID_WEIGHT).cast("int"), F.round(tags * TAG_WEIGHT).cast("int"))

    each = [best(w) for w in words]
    mean = F.when(F.least(*each, F.lit(EXACT)) > 0, F.round(reduce(lambda a, b: a + b, each) / len(words)).cast("int")).otherwise(0)
    score = F.when(whole > 0, whole + WHOLE_QUERY).otherwise(mean)
    return concepts.select("id", "title", score.cast("int").alias("score")).filter("score > 0")


def best_titles(concepts: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best title matches: by score, then shorter title, title and id."""
    return title_matches(concepts, query).orderBy(F.col("score").desc(), F.length("title"), "title", "id").limit(limit)


def snippet(text: Column, word: str, length: int = 220) -> Column:
    """About ``length`` characters around the first ``word``, cut at spaces, with an ellipsis where cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.instr(F.lower(flat), word.lower())
    raw_start = F.greatest(at - 1 - length // 3, F.lit(0))
    next_space = F.locate(" ", flat, 1)
    next_space = F.call_function("locate", F.lit(" "), flat, raw_start + 1) - 1
    start = F.when((raw_start > 0) & (next_space >= 0) & (next_space < at - 1), next_space + 1).otherwise(raw_start)
    window = F.substring(flat, start + 1, F.lit(length + 1))
    whole = start + length >= F.length(flat)
    last_space = F.length(window) - F.instr(F.reverse(window), " ")
    keep = F.when(whole, F.length(flat) - start).when((F.instr(F.reverse(window), " ") > 0) & (last_space > 0) & ((at == 0) | (start + last_space >= at - 1 + len(word))), last_space).otherwise(F.lit(length))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, keep), F.when(start + keep < F.length(flat), "…").otherwise(""))
    return F.when(F.length(flat) <= length, flat).otherwise(cut)


def directories(files: DataFrame) -> DataFrame:
    """directory, depth and n_files (at any depth) of all directories that files (path) imply.

    Each file counts in each directory above it, before the shuffle.
    """
    above = files.select(F.explode(implied_directories(F.col("path"))).alias("directory"))
    return above.groupBy("directory").agg(F.count("*").alias("n_files")).withColumn("depth", F.size(F.split("directory", "/")) - 1)


def letters_in_order(text: Column, needle: str) -> Column:
    """Score of a text that holds the letters of ``needle`` in order: 300, less 4 a skipped letter and 6 a run; 0 for none.

    Letters that lie too far apart do not count, nor does a single letter.
    """
    letters = [c for c in needle if c != " "]
    if len(needle) < 2 or not letters:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gaps"), F.lit(0).alias("runs"), F.lit(True).alias("ok"))

    def step(done: Column, letter: Column) -> Column:
        found = F.call_function("instr", F.substring(text, done["at"] + 1, F.length(text)), letter)
        return F.struct(
            (done["at"] + found).alias("at"),
            (done["gaps"] + F.greatest(found - 1, F.lit(0))).alias("gaps"),
            (done["runs"] + F.when((found == 1) & (done["runs"] > 0), 0).otherwise(1)).alias("runs"),
            (done["ok"] & (found > 0)).alias("ok"),
        )

    end = F.aggregate(F.array(*map(F.lit, letters)), start, step)
    score = 300 - end["gaps"] * 4 - end["runs"] * 6
    return F.when(text.isNotNull() & end["ok"] & (end["gaps"] <= len(needle) * 3 + 6) & (score > 0), score).otherwise(0)


def loose_title_matches(concepts: DataFrame, query: str) -> DataFrame:
    """``title_matches``, and titles that only hold the query's letters in order, with their lower scores."""
    needle = " ".join(query.lower().split())
    exact = title_matches(concepts, query)
    loose = concepts.join(exact.select("id"), "id", "left_anti").select("id", "title", letters_in_order(F.lower("title"), needle).alias("score")).filter("score > 0")
    return exact.unionByName(loose.withColumn("score", (F.col("score") + WHOLE_QUERY).cast("int")))


def tree_filter(files: DataFrame, query: str, keep: str | None = None) -> DataFrame:
    """node and is_file of the tree rows that a query leaves: files that match it and all directories above them.

    ``files`` has path, label, type and tags.  A file matches by label, path,
    type or tag, in any case; ``keep``, the open file, always stays.
    """
    needle = query.strip()
    has = lambda c: contains_text(c, needle)
    matches = F.lit(True) if not needle else has(F.col("label")) | has(F.col("path")) | has(F.col("type")) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), has)
    if keep is not None:
        matches = matches | (F.col("path") == keep)
    found = files.filter(matches)
    above = found.select(F.explode(implied_directories(F.col("path"))).alias("node")).distinct()
    return found.select(F.col("path").alias("node"), F.lit(True).alias("is_file")).unionByName(above.withColumn("is_file", F.lit(False)))


def type_order(name: Column) -> list[Column]:
    """Sort keys of type names: in any case, blank ones last, then as written."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    return [blank.asc(), F.lower(name).asc(), name.asc()]


def type_tree(files: DataFrame) -> DataFrame:
    """type, n_files and position of the groups of a tree by type."""
    from pyspark.sql import Window

    counted = files.groupBy(F.coalesce("type", F.lit("")).alias("type")).agg(F.count("*").alias("n_files"))
    return counted.withColumn("position", F.row_number().over(Window.orderBy(*type_order(F.col("type")))))  # one row a type
