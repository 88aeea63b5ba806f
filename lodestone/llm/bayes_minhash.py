"""Near duplicates by MinHash bands and sequential Bayesian verification.

Texts with equal shingle sets are one node.  A set's signature has a minimum for
each of some two hundred hash functions; sets that agree on all minima of a band
meet in that band's bucket.  Signatures of candidates are compared batch by
batch, and a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below a chosen bound.  What survives is
verified on whole sets.

A bucket's members are first held against its smallest set, one pair a set, so
that copies cost one verification each.  Buckets whose members are not all
connected then are chained into families, whose signatures are compared in
blocks inside tasks.  That tells which sets have a surviving partner in another
component, and how survivors hang together; such sets alone are sent again, with
their tokens, to be verified in blocks.  No pairs are listed within a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, materialise, release_worker_state, trim_memory
from .signature_join import BATCH_ROWS, ROW_KEY, _set_hashes, _signed, _slim, _texts, _WordHashes, by_group, components, family_blocks, shared_groups, shingle_set, similar, wanted_sets

#: Probability of losing a pair at the threshold: in the bands, and in each step of the verification.
MISS = 1e-7
#: Minima in a band, and minima compared in a step.
BAND_ROWS, STEP = 5, 32
#: Parts that the pairs of one set are dealt into, if it has more than so many.
SALTS, PART_PAIRS = 256, 1024
#: Keys broadcast at most.
MAX_BROADCAST = 500_000
#: Signatures in a block of a family, of which a task holds two (2 MB each).
BLOCK_SIGNATURES = 4096


@dataclass(frozen=True)
class Plan:
    """Bands, minima in all, and the least matches after each step that keep a pair."""

    bands: int
    rows: int
    minima: int
    least: tuple[int, ...]


@lru_cache
def plan(percent: int, miss: float = MISS, rows: int = BAND_ROWS) -> Plan:
    """Bands of ``rows`` minima, so many that a pair at the threshold meets in none with a probability of at most ``miss``.

    With a uniform prior and ``m`` of ``n`` minima equal, the similarity has the
    Beta(m + 1, n - m + 1) distribution.  It exceeds the threshold t with the
    probability that n + 1 trials of chance t give at most m hits, so the least
    m for each n is where that sum passes ``miss``.
    """
    t = percent / 100
    bands = 1 if percent == 100 else ceil(log(miss) / log1p(-(t**rows)))
    minima, least = bands * rows, []
    for n in [*range(STEP, minima, STEP), minima]:
        below, m = 0.0, -1
        while m < n and below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        least.append(m)
    return Plan(bands, rows, minima, tuple(least))


def hash_functions(minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``minima`` hash functions, always the same."""
    random = np.random.Generator(np.random.PCG64(97))
    return random.integers(0, 1 << 63, minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, minima, dtype=np.uint64)


def minhash(tokens: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each of ``hash_functions`` over ``tokens`` (mixed 64-bit hashes, one at least)."""
    a, b = functions
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(tokens), 256):
        x = tokens[k : k + 256] * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        values = a[:, None] * x[None, :]
        values += b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band: of its number and its minima."""
    parts = minima.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for k in range(rows):
        key = (key ^ parts[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key


def short(minima: np.ndarray) -> np.ndarray:
    """16 bits of each minimum: unequal ones may look equal once in 65,536 times, which drops no pair."""
    return (minima >> np.uint64(48) ^ minima >> np.uint64(20)).astype(np.uint16)


def surviving(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``x`` and ``y`` (signatures; set sizes ``m`` and ``n``) no step of the verification drops, and their equal minima."""
    alive = np.flatnonzero((100 * m >= percent * n) & (100 * n >= percent * m))
    hits, width = np.zeros(len(alive), dtype=np.int64), x.shape[1]
    for step, need in enumerate(least):
        if not len(alive):
            break
        at = slice(step * STEP, min(width, (step + 1) * STEP))
        hits += np.count_nonzero(x[alive, at] == y[alive, at], axis=1)
        keep = hits >= need
        alive, hits = alive[keep], hits[keep]
    return alive, hits


def surviving_pairs(n: np.ndarray, component: np.ndarray, side: np.ndarray, signatures: np.ndarray, percent: int, least: tuple[int, ...], cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components (``cross``: of different sides) that the verification keeps, some at a time.

    Rows are compared in order of size, with those that are not too large; a
    row's likeliest partners come first.
    """
    order = np.argsort(n, kind="stable")
    sizes, head = n[order], signatures[order][:, :STEP]
    for k in range(len(order)):
        end = int(np.searchsorted(sizes, 100 * int(sizes[k]) // percent, side="right"))
        if end <= k + 1:
            continue
        # the first step of all partners in one go, the others for what it leaves
        near = np.count_nonzero(head[k + 1 : end] == head[k], axis=1) >= least[0]
        mates = order[k + 1 : end][near]
        mates = mates[component[mates] != component[order[k]]]
        if cross:
            mates = mates[side[mates] != side[order[k]]]
        if len(mates):
            me = np.full(len(mates), order[k])
            kept, hits = surviving(signatures[me], signatures[mates], n[me], n[mates], percent, least)
            if len(kept):
                kept = kept[np.argsort(-hits, kind="stable")]
                yield me[kept], mates[kept]


def document_signatures(documents: DataFrame, shingle: int, steps: Plan) -> DataFrame:
    """Row key, n, h1, h2 (hashes of the set), bands (array<long>) and sig (binary) of every row; n = 0 has none."""
    functions = hash_functions(steps.minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        hashes = _WordHashes()
        for batch in batches:
            n, ids, bands, sigs = [], [], [], []
            for raw in _texts(batch):
                tokens = shingle_set(raw, shingle, hashes)
                n.append(len(tokens))
                ids.append(_set_hashes(tokens))
                minima = minhash(tokens, functions) if len(tokens) else None
                bands.append([] if minima is None else _signed(band_keys(minima, steps.rows)))
                sigs.append(b"" if minima is None else short(minima).tobytes())
            h1, h2 = zip(*ids) if ids else ((), ())
            new = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *new], [*ROW_KEY, "n", "h1", "h2", "bands", "sig"])
        hashes.clear()
        trim_memory()

    return _slim(documents).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, h1 long, h2 long, bands array<long>, sig binary")


def distinct_signatures(docs: DataFrame) -> DataFrame:
    """set_id (a number of its own), h1, h2, the smallest row key, n, bands and sig of every distinct set; write it before use."""
    named = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ROW_KEY)).alias("row")
    sets = docs.filter("n > 0").groupBy("h1", "h2").agg(named, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    return sets.select(F.monotonically_increasing_id().alias("set_id"), "h1", "h2", "row.doc_id", "row.k1", "row.k2", "n", "bands", "sig")


def star_pairs(pairs: DataFrame, sets: DataFrame, payload: str, test: Callable[[list, list, list], np.ndarray], columns: str = "n long") -> DataFrame:
    """The pairs (a, b) that ``test`` keeps, given the payloads of the sets at their ends.

    Pairs of an ``a`` with more than ``PART_PAIRS`` are dealt into ``SALTS``
    parts, and each part gets ``a``'s payload once, however many pairs it has.
    ``test(head, n, payloads)`` says of each member whether to keep it.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
    large = pairs.groupBy("a").agg(F.count("*").alias("pairs")).filter(F.col("pairs") > PART_PAIRS).select("a", F.lit(True).alias("large"))
    if large.count() <= MAX_BROADCAST:  # one for PART_PAIRS pairs at most
        salted = pairs.select("a", "b").join(F.broadcast(large), "a", "left").select("a", "b", F.when(F.col("large"), salt).otherwise(F.lit(0)).alias("salt"))
    else:
        salted = pairs.select("a", "b", salt.alias("salt"))
    heads = salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("set_id"))
    ends = salted.select("a", "salt", "b", F.col("b").alias("set_id")).unionByName(heads)
    rows = ends.join(sets.select("set_id", "n", F.col(payload).alias("payload")), "set_id").select("a", "salt", "b", "n", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            a, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if key != (a[start], salt[start]):  # the first row of a part is its head, which has no b
                    key, head = (a[start], salt[start]), (part.column(3)[0].as_py(), part.column(4)[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    keep = test(head, part.column(3).to_numpy(), part.column(4))
                    yield part.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(run, "a long, b long")


def plausible_stars(pairs: DataFrame, sets: DataFrame, percent: int, steps: Plan) -> DataFrame:
    """Pairs that the sequential verification keeps; ``sets`` have set_id, n and sig."""

    def test(head: tuple, n: np.ndarray, payload: pa.Array) -> np.ndarray:
        members = np.frombuffer(b"".join(payload.to_pylist()), dtype=np.uint16).reshape(len(n), -1)
        keep = np.zeros(len(n), dtype=bool)
        kept, _ = surviving(np.broadcast_to(np.frombuffer(head[1], dtype=np.uint16), members.shape), members, np.full(len(n), head[0]), n, percent, steps.least)
        keep[kept] = True
        return keep

    return star_pairs(pairs, sets, "sig", test)


def verified_stars(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold; ``tokens`` have set_id and tokens."""

    def test(head: tuple, _: np.ndarray, payload: pa.Array) -> list[bool]:
        one = np.frombuffer(head[1], dtype=np.uint64)
        return [similar(one, np.frombuffer(x.as_py(), dtype=np.uint64), percent) for x in payload]

    return star_pairs(pairs, tokens.withColumn("n", F.lit(0)), "tokens", test)


def survivors(placed: DataFrame, sets: DataFrame, percent: int, steps: Plan) -> DataFrame:
    """What the signatures of block pairs (``placed``: family, i, j, side, set_id, component) leave to verify, as (a, b).

    A row of a = b names a set with a surviving partner in another component.
    The other rows connect all components of a block pair that have surviving
    pairs between them, with fewer rows than components.
    """

    def work(group: pa.Table) -> pa.RecordBatch | None:
        ids, n, component, side = (group.column(c).to_numpy() for c in ("set_id", "n", "component", "side"))
        signatures = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint16).reshape(group.num_rows, -1)
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        _, root = np.unique(component, return_inverse=True)
        found, left, right = np.zeros(group.num_rows, dtype=bool), [], []
        for i, j in surviving_pairs(n, component, side, signatures, percent, steps.least, cross):
            found[i] = found[j] = True
            while len(apart := np.flatnonzero(root[i] != root[j])):
                x, y = i[apart[0]], j[apart[0]]
                root[root == root[y]] = root[x]
                left.append(x)
                right.append(y)
        if not found.any():
            return None
        own = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate([own, x]).astype(np.int64)]) for x in (left, right)], ["a", "b"])

    rows = placed.join(sets.select("set_id", "n", "sig"), "set_id").select("family", "i", "j", "side", "set_id", "component", "n", "sig")
    return by_group(rows, ["family", "i", "j"], work, "a long, b long").distinct()


def block_links(rows: DataFrame, percent: int, steps: Plan) -> DataFrame:
    """Links (a, b) that connect what can be connected in each block pair: rows of ``placed`` with n, sig and tokens.

    A set is held against all its surviving partners at once, without those that
    earlier links of the task connect it with.
    """

    def work(group: pa.Table) -> pa.RecordBatch | None:
        ids = group.column("set_id").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("tokens").to_pylist()]
        signatures = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint16).reshape(group.num_rows, -1)
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        n, component, side = (group.column(c).to_numpy() for c in ("n", "component", "side"))
        _, root = np.unique(component, return_inverse=True)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)  # the block's sets as rows of a sparse matrix
        start = np.concatenate([[0], np.cumsum(n)])
        mine = np.zeros(len(codes), dtype=bool)
        links = []
        for i, j in surviving_pairs(n, component, side, signatures, percent, steps.least, cross):
            x = int(i[0])  # the same set in all of them
            mates = j[root[j] != root[x]]
            if not len(mates):
                continue
            own, size = codes[start[x] : start[x + 1]], n[mates]
            begin = np.cumsum(size) - size
            mine[own] = True
            both = np.add.reduceat(mine[codes[np.repeat(start[mates] - begin, size) + np.arange(int(size.sum()))]], begin, dtype=np.int64)
            mine[own] = False
            for y in mates[100 * both >= percent * (n[x] + size - both)].tolist():
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"]) if links else None

    return by_group(rows, ["family", "i", "j"], work, "a long, b long")


def _buckets(sets: DataFrame, work: Scratch) -> DataFrame:
    """token, set_id, hub and weight of the members of buckets that different sets share, as ``shared_groups`` names them."""
    rows = sets.select("set_id", F.explode("bands").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token")
    rows = work(rows.join(shared, "token", "left_semi"), "shared-bands")  # most bands are one set's
    return work(rows.join(work(shared_groups(rows), "buckets"), "token"), "members")


def _links(documents: DataFrame, sets: DataFrame, shingle: int, percent: int, steps: Plan, work: Scratch) -> DataFrame:
    """Links (a, b) of set ids that connect all sets which links at the threshold connect."""
    members = _buckets(sets, work)
    # each set against the smallest of the bucket that it shares most bands with
    hubs = members.filter("hub <> set_id").groupBy("set_id", "hub").agg(F.sum("weight").alias("n")).groupBy("set_id").agg(F.max_by("hub", F.struct("n", F.negative("hub"))).alias("hub"))
    pairs = work(hubs.select(F.col("hub").alias("a"), F.col("set_id").alias("b")), "hubs")
    pairs = work(plausible_stars(pairs, sets, percent, steps), "hub-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    links = work(verified_stars(pairs, wanted_sets(documents, sets, ends, shingle, work), percent), "hub-links")

    # buckets that are not all connected, as families
    first = work(components(links, work), "first-components").select(F.col("node").alias("set_id"), "component")
    known = members.select("token", "hub", "set_id").join(first, "set_id", "left").select("token", "hub", "set_id", F.coalesce("component", "set_id").alias("component"))
    known = work(known, "known-sets")
    apart = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    chosen = work(known.join(apart, "token", "left_semi"), "open-buckets")
    if not chosen.limit(1).count():
        return links
    family = work(components(chosen.select(F.col("hub").alias("a"), F.col("set_id").alias("b")), work), "families")
    sizes = chosen.select("set_id", "component").distinct().join(sets.select("set_id", "n"), "set_id")
    placed = family_blocks(work(_in_families(sizes, family), "family-members"), percent, BLOCK_SIGNATURES, 1 << 40)
    left = work(survivors(work(placed, "family-blocks"), sets, percent, steps), "survivors")

    # what signatures cannot tell apart: whole sets, in families of survivors
    closer = work(components(left.filter("a <> b").unionByName(links), work), "survivor-families")
    kept = sizes.join(left.filter("a = b").select(F.col("a").alias("set_id")), "set_id", "left_semi")
    placed = work(family_blocks(work(_in_families(kept, closer), "survivor-members"), percent), "survivor-blocks")
    tokens = wanted_sets(documents, sets, placed.select("set_id").distinct(), shingle, work)
    rows = placed.join(sets.select("set_id", "n", "sig"), "set_id").join(tokens, "set_id")
    return links.unionByName(work(block_links(rows, percent, steps), "block-links"))


def _in_families(members: DataFrame, family: DataFrame) -> DataFrame:
    return members.join(family.select(F.col("node").alias("set_id"), F.col("component").alias("family")), "set_id").select("family", "set_id", "component", "n")


def minhash_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents``.

    Rows are linked where the Jaccard similarity of their shingle sets is at
    least ``percent`` hundredths, which whole sets confirm; a pair at the
    threshold is overlooked with a probability of about ``miss``, others less.
    ``component_id`` is the smallest doc_id that links reach, ``kept`` says that
    it is the row's own.  Null and empty texts have no set, are linked with
    nothing and are kept.  Rows of equal doc_id are rows like others, and so are
    rows of null doc_id; null doc_ids are ignored in component_id unless a
    component has no other, and then kept.  No rows give no rows; other columns
    are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100: sets of one pair may differ in size by no more than half")
    steps = plan(percent, miss)
    work, early = Scratch(documents.sparkSession, "minhash-duplicates"), Scratch(documents.sparkSession, "document-signatures")
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        docs = early(document_signatures(documents, shingle, steps), "document-signatures")
        rows = materialise(docs.select("doc_id", "n", "h1", "h2"), "document-sets")
        sets = work(distinct_signatures(docs), "distinct-sets")
        early.clear()  # copies' signatures are needed no more
        links = _links(documents, sets, shingle, percent, steps, work)
        joined = components(links.distinct(), work).withColumnRenamed("node", "set_id")
        groups = sets.select("set_id", "h1", "h2", "doc_id").join(joined, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        smallest = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        labels = materialise(groups.join(smallest, "component").select("h1", "h2", "component_id"), "labels")
    work.clear()
    out = rows.join(labels, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
