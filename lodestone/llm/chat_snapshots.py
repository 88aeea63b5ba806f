"""Chat logs: collapse cumulative snapshots, then render.

Chat services log a conversation again after each turn, so the log holds every
prefix of it.  A rolling hash of the turns so far names each prefix; a
conversation whose whole hash is a prefix of a longer one is dropped by an
anti-join, and equal conversations keep their smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and its turns, ordered by turn, role and text (nulls first).

    Exactly repeated rows count once.  Turns may have gaps; rows of equal turn
    number follow each other by role and text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def with_hashes(chats: DataFrame) -> DataFrame:
    """Add ``prefixes``: the rolling hash after each turn of ``turns``."""

    def step(done: Column, turn: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(F.sha2(F.concat_ws("\x1f", last, F.hex(turn["role"]), turn["text"]), 256)))

    rolled = F.aggregate("turns", F.array().cast("array<string>"), step)
    return chats.withColumn("prefixes", rolled)


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, n_turns and chain of the conversations that no other one extends.

    ``chain`` is the rolling hash of the whole conversation.  Of equal
    conversations the one of smallest conv_id stays (null is smallest).
    Conversations are compared by role and text alone, so a shift of turn
    numbers does not hide a prefix.  A null turn comes first, null roles and
    texts are empty ones, other columns are not read.  Empty table: no rows.
    """
    hashed = with_hashes(turn_arrays(conversations)).withColumn("n_turns", F.size("turns"))
    slim = hashed.select("conv_id", "n_turns", F.element_at("prefixes", -1).alias("chain"))
    # each proper prefix once, combined before the shuffle: a first turn that
    # a third of all conversations share is one row a task
    inner = hashed.select(F.explode(F.slice("prefixes", F.lit(1), F.greatest(F.size("prefixes") - 1, F.lit(0)))).alias("chain")).distinct()
    keepers = slim.groupBy("chain").agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("k"), F.min("n_turns").alias("n_turns"))
    kept = keepers.join(inner, "chain", "left_anti").select(F.col("k.conv_id").alias("conv_id"), "chain", "n_turns")
    turns = turn_arrays(conversations).select(F.col("conv_id").alias("__conv"), "turns")
    return kept.join(turns, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")


def render(turns: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Turns as one training text: a header with the role, the text, an end mark, for each turn.

    Marks inside a role or text are parted by a space, so that what somebody
    writes cannot end a turn or begin one.
    """

    def plain(text: Column) -> Column:
        for mark in (start, end):
            text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
        return text

    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(start), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(end + "\n"))), "")


def chat_texts(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, chain and rendered text of each maximal conversation."""
    return maximal_conversations(conversations).select("conv_id", F.col("n_turns").cast("int").alias("n_turns"), "chain", render(F.col("turns")).alias("text"))
