"""Sharding by histogram sort.

Rows are ordered by a string key.  Splitters that cut the order into parts of
equal bytes are found by probing: each round counts the exact bytes and rows
that fall between candidate boundaries, over all partitions, and the next round
probes only inside the intervals that still hold a splitter.  When every
splitter is within the tolerance, rows are exchanged once, to their part.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, materialise

#: Characters of the key that one round of probes tells apart (16**3 intervals), and intervals of a round that the driver gets at most.
PROBE_CHARS, MAX_PROBES = 3, 1 << 20
#: Rows that a task sorts, as far as ``MAX_PARTS`` allows; parts of a shard at least.
PART_ROWS, MAX_PARTS, MIN_PARTS = 2_000_000, 1024, 8


@dataclass(frozen=True)
class Cuts:
    """Splitter keys, and the exact rows and bytes before each of them."""

    keys: list[str]
    rows: list[int]
    bytes: list[int]
    total_rows: int
    total_bytes: int


def _pick(splitters: list[str], key: Column, low: int, high: int) -> Column:
    """Number of splitters at or below ``key``, as a binary tree of comparisons."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < splitters[mid], _pick(splitters, key, low, mid)).otherwise(_pick(splitters, key, mid + 1, high))


def find_cuts(sized: DataFrame, n_parts: int, tolerance: float = 0.0, probe_chars: int = PROBE_CHARS, totals: tuple | None = None) -> Cuts:
    """Splitters of ``sized`` (key string, size long) into ``n_parts`` parts of equal bytes.

    A splitter for target ``t`` is the smallest key with at least ``t`` bytes
    before it; with ``tolerance`` above 0, any probe whose bytes are within
    ``tolerance`` times a part's size of ``t`` is taken.  What reaches the
    driver is one row per interval between probes: of keys in hexadecimal at
    most ``16**probe_chars * n_parts`` a round, whatever the size of the table.
    ``totals`` are ``totals_of(sized)``, where they are known.
    """
    total_rows, total, greatest = totals or totals_of(sized)
    keys, rows, below = [""] * (n_parts - 1), [0] * (n_parts - 1), [0] * (n_parts - 1)
    if not total:
        return Cuts([], [], [], 0, 0)
    slack = tolerance * total / n_parts
    # An open interval: first key, last key, rows and bytes before it, what follows it.
    whole = ("", greatest, 0, 0, None, 0)
    open_by: dict[tuple, list[int]] = {whole: list(range(1, n_parts))}
    while open_by:
        intervals = sorted(open_by, key=lambda x: x[0])
        inside = F.lit(None).cast("int")
        for number, (first, last, *_) in enumerate(intervals):
            skip = F.lit(len(commonprefix([first, last])) + 1)
            hit = F.col("key").between(first, last)
            inside = F.when(hit, F.struct(F.lit(number).alias("n"), F.substring("key", skip, F.lit(probe_chars)).alias("at"))).otherwise(inside) if number else F.when(
                hit, F.struct(F.lit(number).alias("n"), F.substring("key", skip, F.lit(probe_chars)).alias("at"))
            )
        counted = (
            sized.withColumn("probe", inside)
            .filter("probe is not null")
            .groupBy("probe")
            .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
            .collect()
        )
        found: dict[tuple, list[int]] = {}
        for number, interval in enumerate(intervals):
            buckets = sorted((r for r in counted if r.probe.n == number), key=lambda r: r.first)
            starts, row_starts = [interval[3]], [interval[2]]
            for r in buckets:
                starts.append(starts[-1] + r.n_bytes)
                row_starts.append(row_starts[-1] + r.n_rows)
            firsts = [r.first for r in buckets] + [interval[4]]
            for j in open_by[interval]:
                # compared as integers: bytes * parts against j * total
                at = bisect_left([s * n_parts for s in starts], j * total)
                at = min(at, len(buckets))
                close = min((at, at - 1), key=lambda i: abs(starts[i] - j * total / n_parts)) if at else 0
                inner = buckets[at - 1] if at else None
                if inner is None or inner.first == inner.last or starts[at] * n_parts == j * total:
                    close = at
                elif abs(starts[close] - j * total / n_parts) > slack:
                    key = (inner.first, inner.last, row_starts[at - 1], starts[at - 1], firsts[at], row_starts[at])
                    found.setdefault(key, []).append(j)
                    continue
                keys[j - 1], rows[j - 1], below[j - 1] = firsts[close], row_starts[close], starts[close]
        open_by = found
    # A splitter behind the greatest key cuts nothing off.
    return Cuts([k if k is not None else _behind(greatest) for k in keys], rows, below, total_rows, total)


def totals_of(sized: DataFrame) -> tuple[int, int, str | None]:
    """Rows, bytes and the greatest key of ``sized``."""
    return tuple(sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.max("key")).first())


def _behind(key: str | None) -> str:
    """The least string that is greater than ``key``."""
    return (key or "") + "\0"


def histogram_shards(
    df: DataFrame,
    key: Column,
    size: Column,
    n_shards: int = 8,
    parts_per_shard: int | None = None,
    tolerance: float = 0.0,
    hex_key: bool = False,
) -> DataFrame:
    """Add ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard) to ``df``.

    Shards hold consecutive keys and near equal sums of ``size``.  Each shard is
    made of ``parts_per_shard`` parts with splitters of their own, by default so
    many that a task sorts some ``PART_ROWS`` rows, so no task sorts a whole
    shard.  The exchange deals out the rows by part once.

    * ``key``: string of any characters; nulls order first, equal keys stay
      together.  Probes tell keys apart by the hexadecimal digits of their
      UTF-8 bytes, which keep the order; ``hex_key`` says that keys are
      hexadecimal already.
    * ``size``: long, not negative; null counts as 0.
    * Empty table: no rows.  Fewer rows than shards: some shards stay empty.
    * Columns named ``shard`` or ``slot`` in ``df`` are replaced.
    """
    df = df.drop("shard", "slot")
    plain = F.coalesce(key, F.lit(""))
    keyed = df.withColumns({"__key": plain if hex_key else F.hex(F.encode(plain, "UTF-8")), "__size": F.coalesce(size, F.lit(0)).cast("long")})
    sized = keyed.select(F.col("__key").alias("key"), F.col("__size").alias("size"))
    totals = totals_of(sized)
    if parts_per_shard is None:
        parts_per_shard = max(MIN_PARTS, min(MAX_PARTS // n_shards, -(-totals[0] // (n_shards * PART_ROWS))))
    parts = n_shards * parts_per_shard
    probe_chars = next(c for c in (PROBE_CHARS, 2, 1) if c == 1 or 16**c * parts <= MAX_PROBES)
    cuts = find_cuts(sized, parts, tolerance, probe_chars, totals)
    if not cuts.total_bytes:
        cuts = Cuts([_behind(totals[2])] * (parts - 1), [0] * (parts - 1), [0] * (parts - 1), 0, 0)
    starts = [0, *cuts.rows]
    first_slot = [starts[p] - starts[p - p % parts_per_shard] for p in range(parts)]
    placed = keyed.withColumn("__part", _pick(cuts.keys, F.col("__key"), 0, parts - 1).cast("int"))
    order = Window.partitionBy("__part").orderBy("__key")
    return (
        placed.withColumn("slot", F.row_number().over(order) - 1 + F.element_at(F.array(*map(F.lit, first_slot)), F.col("__part") + 1).cast("long"))
        .withColumn("shard", F.floor(F.col("__part") / parts_per_shard).cast("int"))
        .drop("__key", "__size", "__part")
    )


def document_key(doc_id: Column, text: Column) -> Column:
    """Order of documents: by the text's MD5, so equal texts are neighbours, then by doc_id (null first)."""
    signed = F.when(doc_id.isNull(), "").otherwise(F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    return F.concat(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), signed)


def shard_documents(documents: DataFrame, n_shards: int = 8, tolerance: float = 0.0) -> DataFrame:
    """Shards of a documents table by the ``bytes`` law, one slim row per document.

    Size is the text's UTF-8 bytes (a null text has none) plus 1; ``text_crc32``
    of a null text is that of the empty text.  Repeated rows each get a slot.
    """
    slim = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_of(F.col("text")).alias("text_crc32"),
        document_key(F.col("doc_id"), F.col("text")).alias("order_key"),
    )
    slim = materialise(slim, "shard-keys")
    out = histogram_shards(slim, F.col("order_key"), F.col("size"), n_shards, tolerance=tolerance, hex_key=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
