"""Merkle manifest of a table: a hash tree for each group of rows, one root over all, and a proof for each row.

Rows are leaves.  Each group's leaves get row numbers in key order; a level of
nodes becomes the next one by dividing numbers by the fanout, gathering the
sorted children of each parent and hashing them.  When every group is down to
its subroot, the subroots form a tree of their own.  Proofs are made downwards:
each level joins its nodes with their parents' siblings, so that all levels
together join two rows for each leaf, not a row for each leaf and level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows broadcast at most (some 2 KB each, of trees' tops); beyond that a join shuffles.
MAX_BROADCAST = 10_000
#: Nodes of a level that a task writes at least.
TASK_NODES = 200_000
#: Steps of a proof, from a node upwards: hashes of the siblings left and right of it, as one text each.
PATH = "array<struct<left string, right string>>"


def encoded(*values: Column) -> Column:
    """Texts of ``values`` one after the other, none of which can be taken for another: ``-`` of null, else bytes, ``:``, value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``idx`` (long, from 0 in each ``group`` by ``order``) and ``size`` (rows of the group).

    Rows are sorted over range partitions and numbered by their place in one
    and the rows before it, so that a group of any size is dealt over tasks.
    Rows that tie are told apart by the place they were read from.
    """
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    keys = [group, *order, "__salt"]
    placed = materialise(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__salt"), "sorted-leaves")
    part = F.shiftright("__at", 33).alias("__part")  # the number of the partition; below it the place
    spans = placed.groupBy(group, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = materialise(
        spans.select(group, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("size")),
        "spans",
    )
    small = F.broadcast(spans) if spans.count() <= MAX_BROADCAST else spans  # one row a partition and group
    joined = placed.withColumn("__part", part).join(small, [group, "__part"])
    return joined.withColumn("idx", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def grown(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Written levels above ``leaves`` (tree, idx, size, node): tree, idx, size, node and run, the children's nodes in order.

    A tree's levels end with the one of size 1; a tree of one leaf has none.
    """
    sizes = leaves.select("tree", "size").distinct().agg(F.max("size"), F.sum("size")).first()
    most, total = sizes[0] or 0, sizes[1] or 0
    level, levels = leaves.select("tree", "idx", "size", "node"), []
    while most > 1:
        parent = F.expr(f"idx div {fanout}")
        runs = level.filter("size > 1").groupBy("tree", parent.alias("up")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("run"))
        up = runs.select("tree", F.col("up").alias("idx"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"), F.col("run.node").alias("run"))
        up = up.withColumn("node", F.sha2(F.array_join("run", ""), 256))
        most, total = -(-most // fanout), -(-total // fanout)
        level = materialise(up.coalesce(max(1, total // TASK_NODES)), "merkle-level")
        levels.append(level)
    return levels


def _step(run: str, idx: Column, fanout: int) -> Column:
    """What stands left and right of child number ``idx`` in its parent's run."""
    at = F.pmod(idx, F.lit(fanout)).cast("int")
    both = F.struct(F.array_join(F.slice(run, F.lit(1), at), "").alias("left"), F.array_join(F.slice(run, at + 2, F.lit(fanout)), "").alias("right"))
    return F.array(both).cast(PATH)


def with_paths(nodes: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """``nodes`` (tree, idx and more) with ``path``, the steps from each up to the top of its tree."""
    none = F.array().cast(PATH)

    def below(rows: DataFrame, above: DataFrame) -> DataFrame:
        ups = above.select("tree", F.col("idx").alias("up"), F.col("run").alias("siblings"), F.col("path").alias("onward"))
        joined = rows.withColumn("up", F.expr(f"idx div {fanout}")).join(ups, ["tree", "up"], "left")
        path = F.when(F.col("siblings").isNull(), none).otherwise(F.concat(_step("siblings", F.col("idx"), fanout), F.col("onward")))
        return joined.withColumn("path", path).drop("up", "siblings", "onward")

    if not levels:
        return nodes.withColumn("path", none)
    at = levels[-1].withColumn("path", none)
    for level in reversed(levels[:-1]):
        at = materialise(below(level.select("tree", "idx", "run"), at), "merkle-paths")
    return below(nodes, at)


@dataclass
class Manifest:
    """``leaves`` with their paths, and ``tops``: tree, subroot, root and the path from the subroot to the root."""

    leaves: DataFrame
    tops: DataFrame


def manifest(leaves: DataFrame, fanout: int = 2) -> Manifest:
    """The trees over ``leaves`` (tree string, node string, idx and size as ``numbered`` gives them, and more)."""
    if fanout < 2:
        raise ValueError("fanout is 2 or more")
    levels = grown(leaves, fanout)
    subroots = leaves.filter("size = 1").select("tree", "node")
    for level in levels:
        subroots = subroots.unionByName(level.filter("size = 1").select("tree", "node"))
    named = subroots.select(F.lit("").alias("top"), F.col("tree").alias("group"), "node")
    roots = materialise(numbered(named, "top", "group").withColumnRenamed("top", "tree"), "subroots")
    upper = grown(roots, fanout)
    root = (upper[-1] if upper else roots).filter("size = 1").select(F.col("node").alias("root"), F.lit("").alias("tree"))
    tops = with_paths(roots, upper, fanout).join(root, "tree").select(F.col("group").alias("tree"), F.col("node").alias("subroot"), "root", F.col("path").alias("top_path"))
    return Manifest(with_paths(leaves, levels, fanout), materialise(tops, "subroot-paths"))


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to by the siblings of ``path``."""
    return F.aggregate(path, node, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def siblings_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def audited(documents: DataFrame, fanout: int = 2, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``documents``.

    A leaf is the hash of doc_id, source, lang, n_chars and text, and ``lang``
    names its tree.  Rows whose unsigned crc32 of the decimal doc_id is divisible
    by ``every`` are tampered with: their ``folded_root`` starts from a leaf with
    one added to n_chars, so ``verified`` is false unless n_chars is null.  Null
    doc_ids come first in their tree and are never tampered with; rows of equal
    doc_id stand by their leaf's hash, and equal rows are leaves like others.
    Null langs have a tree of their own, before all others.  No rows give no
    rows; other columns are not read.
    """
    tree = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit(""))  # keeps order, null before all texts
    plain = encoded(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    added = F.col("n_chars").cast("decimal(20,0)") + 1
    other = encoded(F.col("doc_id"), F.col("source"), F.col("lang"), added, F.col("text"))
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % every == 0
    rows = documents.select("doc_id", tree.alias("tree"), F.sha2(plain, 256).alias("node"), F.when(hit, F.sha2(other, 256)).alias("tampered"))
    leaves = materialise(numbered(materialise(rows, "leaves"), "tree", "doc_id", "node"), "numbered-leaves")
    found = manifest(leaves, fanout)
    tops = F.broadcast(found.tops) if found.tops.count() <= MAX_BROADCAST else found.tops
    out = found.leaves.join(tops, "tree").withColumn("path", F.concat("path", "top_path"))
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", siblings_hash(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
