"""How the word use of sources differs within a language.

A byte-level tokenizer reads the texts of a batch as one buffer: a lookup table
tells which bytes belong to terms, and where that changes, terms begin and end.
Slices are grouped by xxhash, and every slice is compared with its group's first
byte for byte.  A batch's sparse matrix of documents and terms is added up to
sources and terms.  Smoothed frequencies of whole languages are compared in
blocks of terms, as sparse matrices of sources, whose differences are summed by
``reduceat``; a language has as many blocks as its matrix needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialise, trim_memory
from .signature_join import by_group

#: Rows that a Python worker is handed at once, and bytes of text that it works on at once.
BATCH_ROWS, CHUNK_BYTES = 2000, 4_000_000
#: Cells of the matrix of sources and terms that a block has, about.
BLOCK_CELLS = 500_000
#: Rows of totals (one for each source and language) broadcast at most.
MAX_BROADCAST = 100_000
#: Frequencies are counted in parts of SCALE, with SMOOTH added to each count.
SCALE, SMOOTH = 1_000_000_000, 5

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
for _a, _z in ((65, 90), (97, 122)):
    _IN_TERM[_a : _z + 1] = True
_LOWER[65:91] += 32


def term_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the terms in ``data``, the texts one after the other that ``offsets`` cuts."""
    inside = _IN_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]  # a text ends where the next begins, whatever stands there
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def grouped_slices(data: bytes, starts: np.ndarray, ends: np.ndarray, digest: Callable[[memoryview], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms by number."""
    view, raw = memoryview(data), np.frombuffer(data, dtype=np.uint8)
    hashes = np.fromiter((digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))
    _, index, codes = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [data[s:e] for s, e in zip(starts[index].tolist(), ends[index].tolist())]
    lengths, heads = ends - starts, index[codes]
    same = lengths == lengths[heads]
    at = np.flatnonzero(same)
    if len(at):
        n = lengths[at]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        equal = raw[np.repeat(starts[at], n) + inner] == raw[np.repeat(starts[heads[at]], n) + inner]
        same[at] = np.logical_and.reduceat(equal, begin)
    new: dict[bytes, int] = {}
    for k in np.flatnonzero(~same).tolist():  # equal hashes of unequal terms
        codes[k] = new.setdefault(data[starts[k] : ends[k]], len(terms) + len(new))
    return codes, [*terms, *new]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ``keys`` in order, and the sums of ``values`` of each."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        limit = (sizes[start - 1] if start else 0) + CHUNK_BYTES
        end = max(start + 1, int(np.searchsorted(sizes, limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with the term), written; a row of null term for each source.

    Null lang, source and text count as empty texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                yield counted(part)
        trim_memory()

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
        owners: dict[tuple, int] = {}
        group = np.array([owners.setdefault(x, len(owners)) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], dtype=np.int64)
        starts, ends, docs = term_slices(data, offsets - offsets[0])
        codes, terms = grouped_slices(_LOWER[data].tobytes(), starts, ends)
        width = max(1, len(terms))
        cells, n = np.unique(docs * width + codes, return_counts=True)  # documents by terms, row by row
        keys, n, docs_with = summed(group[cells // width] * width + cells % width, n, np.ones(len(cells), dtype=np.int64))
        names = list(owners)
        who, what = keys // width, keys % width
        langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        take = pa.array(np.concatenate([who, np.arange(len(names))]))
        some = pa.array([*terms, None], pa.binary()).take(pa.array(np.concatenate([what, np.full(len(names), len(terms))])))
        none = np.zeros(len(names), dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [langs.take(take), sources.take(take), some.cast(pa.string()), pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs_with, none]))],
            ["lang", "source", "term", "n", "docs"],
        )

    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
        return materialise(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def block_distances(base: np.ndarray, rows: np.ndarray, cols: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source i the sums over all terms of |p_i - p_j|, for the sources j behind it.

    The matrix is given by its cells (``rows`` ascending); what has no cell has
    its source's ``base``.
    """
    n, width = len(base), int(cols.max()) + 1 if len(cols) else 0
    indptr = np.searchsorted(rows, np.arange(n + 1))
    full = np.flatnonzero(indptr[1:] > indptr[:-1])
    for i in range(n):
        own = p[indptr[i] : indptr[i + 1]]
        dense = np.full(width, base[i])
        dense[cols[indptr[i] : indptr[i + 1]]] = own
        # every term as if no source had a cell ...
        ordered = np.sort(own)
        upto = np.concatenate([[0], np.cumsum(ordered)])
        k = np.searchsorted(ordered, base)
        out = (width - len(own)) * np.abs(base - base[i]) + base * (2 * k - len(own)) + upto[-1] - 2 * upto[k]
        # ... and what the cells change
        if len(p):
            here = dense[cols]
            change = np.abs(p - here) - np.abs(base[rows] - here)
            out[full] += np.add.reduceat(change, indptr[full])
        yield i, out[i + 1 :]


def _distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b and value: the sums over all kept terms of the differences of sources a < b of a language."""
    blocks = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_cells") / BLOCK_CELLS)).cast("int").alias("blocks"))
    few = F.broadcast(blocks) if blocks.count() <= MAX_BROADCAST else blocks
    sides = groups.join(few, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    dealt = cells.join(few, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    numbers = F.xxhash64("lang")  # a group's key must be numeric; languages of one number are told apart below

    def work(group: pa.Table) -> pa.RecordBatch | None:
        out = pa.Table.from_batches([distances(group.filter(pc.equal(group.column("lang"), lang)), lang) for lang in pc.unique(group.column("lang"))])
        return out.combine_chunks().to_batches()[0] if out.num_rows else None

    def distances(group: pa.Table, lang: pa.Scalar) -> pa.RecordBatch:
        group = group.sort_by([("source", "ascending")])
        sources = group.column("source").combine_chunks().dictionary_encode()
        names, codes = sources.dictionary, sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        is_base = group.column("term").is_null().to_numpy()
        p = group.column("p").to_numpy()
        base = np.zeros(len(names), dtype=np.int64)
        base[codes[is_base]] = p[is_base]
        cols = group.column("term").combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[~is_base]
        left, right, value = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for i, sums in block_distances(base, codes[~is_base], cols, p[~is_base]):
            left.append(np.full(len(sums), i))
            right.append(np.arange(i + 1, len(names)))
            value.append(sums)
        a, b = (names.take(pa.array(np.concatenate(x))) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(a), pa.string()), a.cast(pa.string()), b.cast(pa.string()), pa.array(np.concatenate(value))], ["lang", "a", "b", "value"])

    rows = dealt.unionByName(sides).withColumn("key", numbers)
    found = by_group(rows, ["key", "block"], work, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergences(documents: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank: how each source of ``documents`` differs within its language.

    A language keeps the terms that stand in ``min_docs`` or more of its rows.
    Part ``pair`` has each other source of the language and the sum over all
    kept terms of the differences of their frequencies, 0 where no term is kept.
    Part ``term`` has the ``top`` terms that the source uses more often than its
    language does, and by how much.  Frequencies are whole numbers in parts of a
    billion, and all arithmetic is exact.  Null lang, source and text count as
    empty texts; rows that repeat count each; a source alone in its language has
    no pairs; no rows give no rows.  Other columns are not read.
    """
    counts = term_counts(documents)
    some = counts.filter("term is not null")
    terms = some.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= min_docs).select("lang", "term", "total")
    kept = materialise(some.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-terms")
    langs = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("lang_sum"), F.count("*").alias("terms"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.count("*").alias("n_cells"))
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")

    def part(count: str, total: str) -> str:
        return f"cast(1 + ({SCALE} * cast({count} + {SMOOTH} as decimal(25,0))) div cast({total} + {SMOOTH} * terms as decimal(25,0)) as long)"

    groups = groups.na.fill(0, ["lang_sum", "terms", "sum", "n_cells"])
    groups = materialise(groups.withColumn("base", F.expr(f"if(terms = 0, 0, {part('0', 'sum')})")), "sources")
    few = F.broadcast(groups) if groups.count() <= MAX_BROADCAST else groups
    cells = materialise(kept.join(few, ["lang", "source"]).select("lang", "source", "term", F.expr(part("n", "sum")).alias("p"), F.expr(part("total", "lang_sum")).alias("q")), "frequencies")

    pairs = materialise(_distances(cells, groups), "source-pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    more = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    out = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return out.unionByName(more.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).filter(F.col("rank") <= top))
