"""Exact Jaccard self-join of word n-gram sets, by signature trees.

Texts with equal sets are one node.  Two sets can only reach the threshold if
they share one of their first tokens in a global order (common tokens last), so
nodes meet in groups, by such prefix tokens.  Each group goes through a
signature tree: the tree's nodes hold OR-combined bitmaps of hashed tokens and
ranges of set sizes, and a dual traversal drops pairs of nodes whose largest
possible overlap, or whose sizes, cannot reach the threshold.  Every pair that
survives is verified on the whole sets.  Groups of more than ``SMALL`` sets are
first thinned by links to the set that a member shares most groups with; what
is still apart is joined into families, whose trees take blocks of one size
band and verify inside the task, so that copies are not listed pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, materialise, release_worker_state, trim_memory

#: A token found in so many prefixes is common and ordered behind all others.
COMMON = 16
#: Bits of the table of common tokens that every task gets: 2 MB, whatever the corpus.
TABLE_BITS = 1 << 24
#: Children of a tree node; sets, and tokens of sets (8 bytes each), in a block of a family, of which a task holds two.
FANOUT, BLOCK, BLOCK_TOKENS = 8, 1024, 1_000_000
#: Sets of a component from which on it fills blocks of its own, which need no comparing with each other.
PURE = 256
#: Sets that share a token are compared pair by pair; groups above this size are compared by family.
SMALL = 32
#: Keys broadcast at most (some 50 bytes each); beyond that a join shuffles.
MAX_BROADCAST = 500_000
#: Rows that a Python worker is handed at once.
BATCH_ROWS = 1000

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a text (UTF-8, any case of A to Z).

    A text of fewer words, but not none, is one shingle; a text without words has none.
    """
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(k, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h = _mixed(h * np.uint64(_MIX[0]) + w[i : i + n])
    return np.unique(h)


def prefix_length(n: int, percent: int) -> int:
    """First tokens of a set of ``n`` of which any set similar enough shares one."""
    return n - -(-percent * n // 100) + 1


def table_slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(8)) & np.uint64(TABLE_BITS - 1)


def ordered_prefix(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Prefix of a sorted set in the global order: rare tokens by hash, then common ones by hash."""
    slots = table_slot(tokens)
    is_common = (common[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)
    p = prefix_length(len(tokens), percent)
    rare = tokens[is_common == 0]
    return rare[:p] if len(rare) >= p else np.concatenate([rare, tokens[is_common == 1][: p - len(rare)]])


def signature(tokens: np.ndarray, sharpness: int = 2) -> bytes:
    """Bitmap of a set: a bit for each token's hash, in a power of two of bits, ``sharpness`` times the set's size or more."""
    width = max(64, 1 << int(sharpness * len(tokens) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(signatures: list[bytes], width: int) -> np.ndarray:
    """Signatures as rows of ``width`` 64-bit words; wider ones are folded, which keeps every token's bit."""
    out = np.zeros((len(signatures), width), dtype=np.uint64)
    for row, raw in zip(out, signatures):
        row[:] = np.bitwise_or.reduce(np.frombuffer(raw, dtype=np.uint64).reshape(-1, width), axis=0)
    return out


def most_overlap(n: np.ndarray, pop: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Most tokens that sets of at most ``n`` tokens and at least ``pop`` bits can share, with ``shared`` bits in common.

    Each bit beyond those in common is a token that the other side lacks.
    """
    return n - np.maximum(0, pop - shared)


class SignatureTree:
    """Levels of nodes over some rows; level 0 is the rows themselves.

    A node holds the OR of its rows' bitmaps, the least number of their bits,
    and ranges of their set sizes, components and sides.  ``own`` marks rows of
    which a pair needs at least one.
    """

    def __init__(self, sizes: np.ndarray, components: np.ndarray, sides: np.ndarray, own: np.ndarray, signatures: np.ndarray) -> None:
        self.order = np.lexsort((sizes, components))
        n, c, s, o, bits = sizes[self.order], components[self.order], sides[self.order], own[self.order], signatures[self.order]
        self.levels = [(bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64), n, n, c, c, s, s, o)]
        low, high = np.minimum.reduceat, np.maximum.reduceat
        while len(self.levels[-1][0]) > FANOUT:
            bits, pop, n0, n1, c0, c1, s0, s1, o = self.levels[-1]
            at = np.arange(0, len(n0), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), low(pop, at), low(n0, at), high(n1, at), low(c0, at), high(c1, at), low(s0, at), high(s1, at), np.logical_or.reduceat(o, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, percent: int, cross: bool) -> np.ndarray:
        """Whether rows below nodes ``i`` and ``j`` could reach the threshold and are still apart."""
        bits, pop, n0, n1, c0, c1, s0, s1, own = self.levels[level]
        keep = (own[i] | own[j]) & ~((c0[i] == c1[j]) & (c1[i] == c0[j]))
        if cross:
            keep &= ~((s0[i] == s1[j]) & (s1[i] == s0[j]))
        keep &= (100 * n1[i] >= percent * n0[j]) & (100 * n1[j] >= percent * n0[i])
        shared = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(most_overlap(n1[i], pop[i], shared), most_overlap(n1[j], pop[j], shared))
        return keep & ((100 + percent) * most >= percent * (n0[i] + n0[j]))

    def pairs(self, percent: int, cross: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that no bound rules out; with ``cross`` only pairs of different sides."""
        top = len(self.levels) - 1
        stack = [(top, *np.triu_indices(len(self.levels[top][1])))]
        child = np.arange(FANOUT)
        while stack:
            level, i, j = stack.pop()
            if len(i) > 20_000:
                stack += [(level, i[k : k + 20_000], j[k : k + 20_000]) for k in range(0, len(i), 20_000)]
                continue
            keep = self.may_link(level, i, j, percent, cross)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                own = i < j
                yield self.order[i[own]], self.order[j[own]]
                continue
            width = len(self.levels[level - 1][1])
            a = (i[:, None] * FANOUT + np.repeat(child, FANOUT)[None, :]).ravel()
            b = (j[:, None] * FANOUT + np.tile(child, FANOUT)[None, :]).ravel()
            inside = (a <= b) & (a < width) & (b < width)
            stack.append((level - 1, a[inside], b[inside]))


def group_candidates(n: np.ndarray, components: np.ndarray, sides: np.ndarray, signatures: list[bytes], percent: int, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that could link, by trees over signatures of one width.

    Sets that can link differ in size by less than half, so their widths are
    equal or next to each other: each width has a tree with its own rows and
    the folded rows of the width above.
    """
    widths = np.array([len(x) // 8 for x in signatures])
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(at) > 1:
            tree = SignatureTree(n[at], components[at], sides[at], widths[at] == width, folded([signatures[k] for k in at], width))
            for i, j in tree.pairs(percent, cross):
                yield at[i], at[j]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column(batch.schema.names.index("text")).cast(pa.binary()):
        yield text.as_py() or b""


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def common_tokens(documents: DataFrame, shingle: int, percent: int, common: int = COMMON) -> np.ndarray:
    """A table of ``TABLE_BITS`` bits of the tokens that stand in ``common`` or more prefixes, counted over all rows.

    Tokens that share a slot are common together, which only changes the order.
    What the driver gets has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        hashes = _WordHashes()
        for batch in batches:
            parts, size = [], 0
            for raw in _texts(batch):
                tokens = shingle_set(raw, shingle, hashes)
                if len(tokens):
                    p = prefix_length(len(tokens), percent)
                    parts.append(tokens[: p + p // 4 + 8].copy())
                    size += len(parts[-1])
                if size > 500_000:
                    yield counted(parts)
                    parts, size = [], 0
            if parts:
                yield counted(parts)
        hashes.clear()
        trim_memory()

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(_signed(tokens)), pa.array(n)], ["token", "n"])

    rows = documents.select("text").mapInArrow(run, "token long, n long")
    frequent = rows.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= common)
    slot = F.shiftrightunsigned("token", 8).bitwiseAND(F.lit(TABLE_BITS - 1))
    words = frequent.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(token, 8) & 63 as int))").alias("bit"))
    table = np.zeros(TABLE_BITS // 64, dtype=np.uint64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


#: What names a row: its doc_id, which may be null or repeated, and 128 bits of hash of its text.
ROW_KEY = ("doc_id", "k1", "k2")


def row_keys(documents: DataFrame) -> DataFrame:
    """``documents`` with the hashes ``__k1`` and ``__k2`` of its texts."""
    return documents.withColumns({"__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), "text")})


def _slim(documents: DataFrame) -> DataFrame:
    return row_keys(documents.selectExpr("cast(doc_id as long) as doc_id", "text")).select("doc_id", F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text")


def _set_hashes(tokens: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of hash of a set, as two signed longs; none of an empty set."""
    if not len(tokens):
        return None, None
    raw = tokens.tobytes()
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh64_intdigest(raw, 1) - (1 << 63)


def document_sets(documents: DataFrame, shingle: int, percent: int, common: np.ndarray) -> DataFrame:
    """Row key, n, h1, h2 (hashes of the set), prefix (array<long>) and sig (binary) of every row; n = 0 has no set."""
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        hashes, table = _WordHashes(), shared.value
        for batch in batches:
            n, ids, prefixes, sigs = [], [], [], []
            for raw in _texts(batch):
                tokens = shingle_set(raw, shingle, hashes)
                n.append(len(tokens))
                ids.append(_set_hashes(tokens))
                prefixes.append(_signed(ordered_prefix(tokens, table, percent)) if len(tokens) else [])
                sigs.append(signature(tokens) if len(tokens) else b"")
            h1, h2 = zip(*ids) if ids else ((), ())
            new = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *new], [*ROW_KEY, "n", "h1", "h2", "prefix", "sig"])
        hashes.clear()
        trim_memory()

    return _slim(documents).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, h1 long, h2 long, prefix array<long>, sig binary")


def distinct_sets(docs: DataFrame) -> DataFrame:
    """set_id (a number of its own), h1, h2, the smallest row key, n, prefix and sig of every distinct set; write it before use."""
    named = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ROW_KEY)).alias("row")
    sets = docs.filter("n > 0").groupBy("h1", "h2").agg(named, F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig"))
    return sets.select(F.monotonically_increasing_id().alias("set_id"), "h1", "h2", "row.doc_id", "row.k1", "row.k2", "n", "prefix", "sig")


def same_row(left: DataFrame, right: DataFrame):
    """Join condition: ``left``'s doc_id, __k1, __k2 are ``right``'s row key, null ids included."""
    return left["doc_id"].cast("long").eqNullSafe(right["__id"]) & (left["__k1"] == right["k1"]) & (left["__k2"] == right["k2"])


def whole_sets(documents: DataFrame, wanted: DataFrame, shingle: int, write=materialise) -> DataFrame:
    """set_id and tokens (binary, sorted 64-bit hashes) of the sets in ``wanted`` (set_id and the key of one row that has it).

    Rows that repeat a key give their set once: once a task, and where that
    leaves repeats, once in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            ids, sets = [], []
            for set_id, raw in zip(batch.column(0).to_pylist(), _texts(batch)):
                if set_id not in seen:
                    seen.add(set_id)
                    ids.append(set_id)
                    sets.append(shingle_set(raw, shingle, hashes).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["set_id", "tokens"])
        hashes.clear()
        trim_memory()

    asked = wanted.count()
    rows = row_keys(documents.selectExpr("cast(doc_id as long) as doc_id", "text"))
    some = wanted.select("set_id", F.col("doc_id").alias("__id"), "k1", "k2")
    rows = rows.join(F.broadcast(some) if asked <= MAX_BROADCAST else some, same_row(rows, some)).select("set_id", "text")
    found = write(rows.mapInArrow(run, "set_id long, tokens binary"), "whole-sets")
    return found if found.select("set_id").count() == asked else write(found.dropDuplicates(["set_id"]), "whole-sets")


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that sizes and signatures (of ``sets``) do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, x, n, y in zip(*(batch.column(c).to_pylist() for c in ("m", "x", "n", "y"))):
                ok = 100 * m >= percent * n and 100 * n >= percent * m
                if ok:
                    a, b = folded([x, y], min(len(x), len(y)) // 8)
                    pop, shared = np.bitwise_count(np.stack([a, b])).sum(axis=1, dtype=np.int64), np.bitwise_count(a & b).sum(dtype=np.int64)
                    most = most_overlap(np.array([m, n]), pop, shared).min()
                    ok = (100 + percent) * most >= percent * (m + n)
                keep.append(bool(ok))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("m"), F.col("sig").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), "n", F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * len(x) < percent * len(y) or 100 * len(y) < percent * len(x):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(documents: DataFrame, pairs: DataFrame, sets: DataFrame, shingle: int, percent: int, write=materialise) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets reach the threshold.

    Whole sets are made anew from one text of each set that stands in a pair;
    only those travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3))
            keep = [similar(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64), percent) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    tokens = wanted_sets(documents, sets, ends, shingle, write)
    left = tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("left"))
    right = tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long")


def wanted_sets(documents: DataFrame, sets: DataFrame, ids: DataFrame, shingle: int, write=materialise) -> DataFrame:
    """set_id and tokens of the sets named in ``ids``."""
    wanted = write(sets.select("set_id", *ROW_KEY).join(ids, "set_id", "left_semi"), "wanted-sets")
    return whole_sets(documents, wanted, shingle, write)


def components(edges: DataFrame, write=materialise) -> DataFrame:
    """node and component (its smallest node) of every node in ``edges`` (a, b), by alternating large and small stars.

    Each round joins edges with the smallest neighbour of a node; both are
    written first, so that a node with very many edges is split over tasks.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, state = write(both, "edges"), None
    if not now.limit(1).count():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        either = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(either.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = either.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = write(large, "large-star")
        least = write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = write(small.filter("u <> v").distinct(), "small-star")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == state:
            break
        state = mark
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Deal ``rows`` out by ``keys`` and give each group, as a table, to ``work``, which returns a batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in keys):
                    if (found := work(pa.Table.from_batches(held))) is not None:
                        yield found
                    held = []
                held.append(part)
        if held and (found := work(pa.Table.from_batches(held))) is not None:
            yield found
        held.clear()
        trim_memory()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def shared_groups(rows: DataFrame) -> DataFrame:
    """token, hub, size and weight of the groups that prefix rows (token, set_id) form: sets that share a token.

    Tokens that the very same sets share are one group, under the smallest of
    them; ``weight`` is their number.  ``hub`` is the smallest member.  Members
    are counted and hashed by combined aggregates, so a token that very many
    sets share is not one task's work.
    """
    mark = [F.bit_xor(F.xxhash64("set_id", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    shared = rows.groupBy("token").agg(F.min("set_id").alias("hub"), F.count("*").alias("size"), *mark).filter("size > 1")
    return shared.groupBy("hub", "size", "mark1", "mark2").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "hub", "size", "weight")


def tree_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the signature trees of small groups leave: rows are token, set_id, n, sig."""

    def work(group: pa.Table) -> pa.RecordBatch | None:
        ids, n = (group.column(c).to_numpy() for c in ("set_id", "n"))
        found = list(group_candidates(n, ids, np.zeros(len(n), dtype=np.int64), group.column("sig").to_pylist(), percent, False))
        if not found:
            return None
        a, b = (ids[np.concatenate(x)] for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return by_group(rows, ["token"], work, "a long, b long").distinct()


def family_blocks(members: DataFrame, percent: int, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """family, i, j, side, set_id and component: the pairs of blocks of each family that may hold a link.

    ``members`` are family, set_id, n and component.  A block has members of
    one band of set sizes, ``block`` sets and ``block_tokens`` of their tokens
    at most, about; sets that can link are of one band or of neighbouring ones.  Components of ``PURE`` sets or more fill blocks of their
    own; two blocks of one component are no pair.
    """
    band = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    large = members.groupBy("family", "component").agg(F.count("*").alias("c")).filter(F.col("c") >= PURE)
    pure = F.coalesce("pure", F.lit(-1)).alias("pure")  # -1: of no component alone
    own = members.join(large.select("family", "component", F.col("component").alias("pure")), ["family", "component"], "left")
    own = own.select("family", "set_id", "component", "n", pure, band.cast("long").alias("band"))
    key = ["family", "pure", "band"]
    sizes = own.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_tokens)).cast("int").alias("parts"))
    number = F.row_number().over(Window.partitionBy("family").orderBy("band", "pure", "part"))
    blocks = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", number)
    left = blocks.select("family", F.col("pure").alias("p"), F.col("block").alias("i"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = blocks.select("family", "pure", F.col("block").alias("j"), "band")
    met = left.join(right, ["family", "band"]).filter("not (p = pure and p >= 0)")
    met = met.select("family", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    sides = met.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"))
    placed = own.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")).drop("parts")
    placed = placed.join(blocks.select(*key, "part", F.col("block").alias("side")), [*key, "part"]).select("family", "side", "set_id", "component")
    return placed.join(sides, ["family", "side"]).select("family", "i", "j", "side", "set_id", "component")


def family_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join up what can be joined in each family: rows are family, i, j, side, set_id, component, tokens.

    A group of equal (family, i, j) has at most two blocks of a family; where
    i < j only pairs of different sides are meant.  The group's signature tree
    gives pairs that could link; each is verified on the whole sets unless
    links found before connect its sets already, so a family of copies costs
    about one verification a copy.
    """

    def work(group: pa.Table) -> pa.RecordBatch | None:
        ids, component, side = (group.column(c).to_numpy() for c in ("set_id", "component", "side"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("tokens").to_pylist()]
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        _, root = np.unique(component, return_inverse=True)
        links = []
        for i, j in group_candidates(np.array([len(s) for s in sets]), component, side, [signature(s, 16) for s in sets], percent, cross):
            apart = root[i] != root[j]
            for a, b in zip(i[apart].tolist(), j[apart].tolist()):
                if root[a] != root[b] and similar(sets[a], sets[b], percent):
                    root[root == root[b]] = root[a]
                    links.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"]) if links else None

    return by_group(rows, ["family", "i", "j"], work, "a long, b long")


@dataclass
class Joined:
    """Written tables: rows with their sets, distinct sets, verified links, and the components of linked sets."""

    docs: DataFrame
    sets: DataFrame
    links: DataFrame
    components: DataFrame


def _joined(documents: DataFrame, shingle: int, percent: int) -> Joined:
    work = Scratch(documents.sparkSession, "near-duplicates")
    docs = materialise(document_sets(documents, shingle, percent, common_tokens(documents, shingle, percent)), "document-sets")
    sets = materialise(distinct_sets(docs), "distinct-sets")
    rows = sets.select("set_id", F.explode("prefix").alias("token"))
    groups = work(shared_groups(rows), "groups")
    members = work(rows.join(groups, "token"), "members")
    slim = sets.select("set_id", "n", "sig")

    # small groups: what their trees leave, each pair verified once
    few = members.filter(F.col("size") <= SMALL).select("token", "set_id").join(slim, "set_id").select("token", "set_id", "n", "sig")
    candidates = work(tree_candidates(few, percent), "candidates")
    tree_links = work(verified(documents, candidates, sets, shingle, percent, work), "tree-links")

    links = tree_links
    if groups.filter(F.col("size") > SMALL).limit(1).count():
        links = links.unionByName(_large_group_links(documents, members.filter(F.col("size") > SMALL), tree_links, sets, shingle, percent, work))
    every = materialise(links.distinct(), "links")
    joined = materialise(components(every, work), "components")
    work.clear()
    return Joined(docs, sets, every, joined)


def _large_group_links(documents: DataFrame, crowd: DataFrame, tree_links: DataFrame, sets: DataFrame, shingle: int, percent: int, work: Scratch) -> DataFrame:
    """Links (a, b) that join up what can be joined in large groups (``crowd``: token, set_id, hub, weight), beyond ``tree_links``."""
    # each set against the hub that it shares most tokens with
    hubs = crowd.filter("hub <> set_id").groupBy("set_id", "hub").agg(F.sum("weight").alias("n")).groupBy("set_id").agg(F.max_by("hub", F.struct("n", F.negative("hub"))).alias("hub"))
    pairs = hubs.select(F.col("hub").alias("a"), F.col("set_id").alias("b")).join(tree_links, ["a", "b"], "left_anti")
    hub_links = work(verified(documents, work(plausible(pairs, sets, percent), "hub-pairs"), sets, shingle, percent, work), "hub-links")
    first = work(components(tree_links.unionByName(hub_links), work), "first-components")

    # what is apart: families of sets that large groups chain together
    known = crowd.select("token", "set_id", "hub").join(first, F.col("set_id") == F.col("node"), "left").select("token", "set_id", "hub", F.coalesce("component", "set_id").alias("component"))
    known = work(known, "known-sets")
    open_tokens = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    apart = work(known.join(open_tokens, "token", "left_semi"), "open-groups")
    family = work(components(apart.select(F.col("hub").alias("a"), F.col("set_id").alias("b")), work), "families")
    chained = apart.select("set_id", "component").distinct().join(family.select(F.col("node").alias("set_id"), F.col("component").alias("family")), "set_id").join(sets.select("set_id", "n"), "set_id")
    placed = work(family_blocks(work(chained, "family-members"), percent), "family-blocks")
    tokens = wanted_sets(documents, sets, placed.select("set_id").distinct(), shingle, work)
    return hub_links.unionByName(family_links(placed.join(tokens, "set_id"), percent))


def _labelled(documents: DataFrame, shingle: int, percent: int) -> tuple[Joined, DataFrame]:
    """The join's tables, and set_id, h1, h2, row key and component (a set_id) of every distinct set."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100: sets of one pair may differ in size by no more than half")
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        found = _joined(documents, shingle, percent)
    known = found.components.withColumnRenamed("node", "set_id")
    return found, found.sets.select("set_id", "h1", "h2", *ROW_KEY).join(known, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``documents``.

    Rows are linked where the Jaccard similarity of their shingle sets is at
    least ``percent`` hundredths; ``component_id`` is the smallest doc_id that
    links reach, and ``n_links`` counts the verified links of the row's set
    that connect it: all of them in groups of up to ``SMALL`` sets, in larger
    ones those that were needed (0 for a text alone; equal sets are linked
    without one).  No pair of different sets at or above the threshold is left
    in two components.  Null and empty texts have no set and are linked with
    nothing.  Rows of equal doc_id are rows like others, and so are rows of null
    doc_id; null doc_ids are ignored in component_id unless a component has no
    other.  Other columns are not read.
    """
    found, groups = _labelled(documents, shingle, percent)
    ends = found.links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    smallest = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = groups.join(ends, "set_id", "left").join(smallest, "component").select("h1", "h2", "component_id", "n_links")
    out = found.docs.select("doc_id", "n", "h1", "h2").join(labels, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns: that of the smallest doc_id, null last.

    Rows that repeat a doc_id stay or go each by its own text; of rows with
    equal doc_id and text one stays.  Rows without a set (null or empty texts)
    all stay.  The rows to drop are counted: up to ``MAX_BROADCAST`` keys are
    broadcast, beyond that the anti-join shuffles.
    """
    found, groups = _labelled(documents.select("doc_id", "text"), shingle, percent)
    rows = found.docs.filter("n > 0").groupBy(*ROW_KEY, "h1", "h2").agg(F.count("*").alias("copies"))
    rows = rows.join(groups.select("h1", "h2", "component"), ["h1", "h2"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ROW_KEY)).alias("first")
    best = materialise(rows.groupBy("component").agg(first, F.sum("copies").alias("total")).filter("total > 1"), "first-rows")
    if best.count() <= MAX_BROADCAST:
        best = F.broadcast(best)  # a component that very many rows share is then not one task's
    is_first = F.col("first").eqNullSafe(F.struct(F.col("doc_id").isNull().alias("none"), *ROW_KEY))
    marked = materialise(rows.join(best, "component").select(F.col("doc_id").alias("__id"), "k1", "k2", is_first.alias("stays"), "copies").filter("not stays or copies > 1"), "near-duplicates")
    n = marked.count()
    if not n:
        return documents
    named = F.broadcast(marked) if n <= MAX_BROADCAST else marked
    keyed = row_keys(documents)
    kept = keyed.join(named, same_row(keyed, marked), "left_anti").select(*documents.columns)
    again = marked.filter("stays")
    if not again.limit(1).count():
        return kept
    some = F.broadcast(again) if n <= MAX_BROADCAST else again
    repeated = keyed.join(some, same_row(keyed, again), "left_semi")
    one = repeated.groupBy("doc_id", "__k1", "__k2").agg(F.first(F.struct(*documents.columns)).alias("row"))
    return kept.unionByName(one.select("row.*"))
