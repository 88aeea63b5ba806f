"""Exact vector search with eligibility filters, passages, reranking and parents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import glob_regex, normalise_path, normalised_path
from ..functions.vectors import unit_rows

#: Query vectors that travel to every task at once, and that a block of more queries has.
QUERY_BLOCK = 4096
#: Rows of a block where queries come in blocks, and rows that are multiplied at once.
ROW_BLOCK, ROW_TILE = 50_000, 2048
#: Queries that such a tile of rows is multiplied with at once; a task holds so many similarities.
QUERY_TILE = 256


@dataclass(frozen=True)
class SearchOptions:
    """Which passages a search may return; alternatives inside a field, all fields must hold.

    A metadata filter is a value, a list of values, or a compiled regular
    expression; the key must be there.
    """

    file_paths: tuple[str, ...] = ()
    file_patterns: tuple[str, ...] = ()
    chunk_types: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)

    def column(self) -> Column:
        """The filter over columns source_path, chunk_type and metadata (map)."""
        path = normalised_path(F.col("source_path"))
        parts = []
        if self.file_paths:
            names = [normalise_path(p) for p in self.file_paths]
            parts.append(reduce(or_, ((path == n) | path.endswith("/" + n) for n in names)))
        if self.file_patterns:
            parts.append(reduce(or_, (path.rlike(glob_regex(normalise_path(p))) for p in self.file_patterns)))
        if self.chunk_types:
            parts.append(F.col("chunk_type").isin(*self.chunk_types))
        for key, wanted in self.metadata.items():
            value = F.try_element_at("metadata", F.lit(key))
            if hasattr(wanted, "pattern"):
                test = value.rlike(wanted.pattern)
            elif isinstance(wanted, (list, tuple, set)):
                test = value.isin(*wanted)
            else:
                test = value == wanted
            parts.append(F.map_contains_key("metadata", key) & test)
        return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False))


def check_vectors(*tables: DataFrame) -> int | None:
    """The one length of all vectors (column ``vector``) of the tables; None if there are no rows.

    Null and empty vectors, null or non-finite entries and unequal lengths are
    refused: a similarity of such vectors would be a number without meaning.
    """
    sizes = set()
    for table in tables:
        odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        row = table.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count_if(F.col("vector").isNull() | odd)).first()
        if row[2]:
            raise ValueError(f"{row[2]} vectors are null or have entries that are null or not finite")
        sizes |= {row[0], row[1]} - {None}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    if 0 in sizes:
        raise ValueError("a vector is empty")
    return sizes.pop() if sizes else None


def nearest(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = True, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, sim and rank of the ``k`` most similar rows of ``vectors`` to each query.

    Both inputs have ``id`` and ``vector`` (array of float); ids of queries are
    numbers, those of ``vectors`` numbers or, without ``skip_self``, text.  Every pair
    is scored; similarities are rounded to ``digits`` and ties go to the smaller
    id.  Each task multiplies its rows with a block of queries and passes on its
    own best ``k`` for each query, so what is shuffled grows with tasks and
    queries, not with pairs.  Zero vectors have similarity 0 with everything;
    vectors that ``check_vectors`` refuses raise ValueError.
    """

    def best(q_ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best_of_batches(q_ids, q, k, skip_self, digits, batches)

    named = dict(vectors.dtypes)["id"]
    return top_k(_scored_blocks(vectors.select("id", "vector"), queries, best, f"query_id long, id {named}, sim double", block), k)


def nearest_per_document(vectors: DataFrame, queries: DataFrame, document: str, skip_self: bool = True, digits: int = 6, block: int = QUERY_BLOCK, limit: int | None = None) -> DataFrame:
    """query_id, ``document``, id and sim: the most similar passage of every document to each query, then the smallest id.

    Every passage is scored before any is dropped, so no document is missing
    whose best passage ranks low.  Passages may have ids of any type that can
    be ordered; ``skip_self`` needs numbers.  Each batch passes on its best of each
    document; the rest is a combined aggregate.

    With ``limit`` the documents that are not among a query's best ``limit``, by
    similarity, may be missing, and others are not.  Then a batch passes on its
    own best ``limit`` documents of each query, and those that tie with the last
    of them: one of the best has its best passage in some batch, in which fewer
    than ``limit`` documents beat it.
    """
    kind, named = dict(vectors.dtypes)[document], dict(vectors.dtypes)["id"]

    def best(q_ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_TILE):
                yield from _best_of_documents(q_ids, q, skip_self, digits, batch.slice(start, ROW_TILE), limit)

    rows = vectors.select("id", "vector", F.col(document).alias("document"))
    found = _scored_blocks(rows, queries, best, f"query_id long, document {kind}, id {named}, sim double", block)
    best_row = F.min(F.struct((-F.col("sim")).alias("less"), "id")).alias("b")
    return found.groupBy("query_id", "document").agg(best_row).select("query_id", F.col("document").alias(document), F.col("b.id").alias("id"), (F.lit(0.0) - F.col("b.less")).alias("sim"))


def _scored_blocks(rows: DataFrame, queries: DataFrame, best, schema: str, block: int) -> DataFrame:
    """``best(query ids, unit query vectors, batches of rows)`` for every block of queries and every row.

    Up to ``block`` queries, counted first, travel to every task.  More of them
    are dealt into blocks, as the rows are, and each pair of blocks is a group.
    """
    size = check_vectors(rows, queries)
    n = queries.count()
    if not n or size is None:
        return rows.sparkSession.createDataFrame([], schema)
    if n <= block:
        found = queries.select(F.col("id").cast("long"), "vector").orderBy("id").toArrow()
        q_ids, q = found.column(0).to_numpy(), _unit_matrix(found.column(1).combine_chunks(), n)
        return rows.mapInArrow(lambda batches: best(q_ids, q, (b for b in batches if b.num_rows)), schema)
    parts = -(-n // block)
    tiles = -(-rows.count() // ROW_BLOCK)
    left = rows.withColumns({"__tile": F.pmod(F.xxhash64("id"), F.lit(tiles)), "__block": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    right = queries.select("id", "vector").withColumns({"__block": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "__tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    right = right.withColumn("__tile", F.col("__tile").cast("long"))
    names = rows.columns

    def pair(some: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([], schema=arrow)
        if not some.num_rows or not asked.num_rows:
            return empty
        q = _unit_matrix(asked.column("vector").combine_chunks(), asked.num_rows)
        out = list(best(asked.column("id").to_numpy(), q, iter(some.select(names).to_batches(max_chunksize=ROW_TILE))))
        return pa.Table.from_batches([b.cast(arrow) for b in out]) if out else empty

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return left.groupBy("__tile", "__block").cogroup(right.groupBy("__tile", "__block")).applyInArrow(pair, schema)


def _unit_matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return unit_rows(np.asarray(vectors.flatten(), dtype=np.float64).reshape(n, -1))


def _best_of_documents(q_ids: np.ndarray, q: np.ndarray, skip_self: bool, digits: int, batch: pa.RecordBatch, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    coded = batch.column(2).dictionary_encode("encode")
    order = pc.sort_indices(pa.table({"code": coded.indices, "id": batch.column(0)}), sort_keys=[("code", "ascending"), ("id", "ascending")])
    ids, codes = batch.column(0).take(order), coded.indices.take(order).to_numpy()
    x = _unit_matrix(batch.column(1), batch.num_rows)[order.to_numpy()]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    lengths = np.diff(np.r_[starts, len(codes)])
    for begin in range(0, len(q_ids), QUERY_TILE):
        asked = q_ids[begin : begin + QUERY_TILE]
        sims = np.round(np.clip(x @ q[begin : begin + QUERY_TILE].T, -1.0, 1.0), digits) + 0.0
        if skip_self:
            sims[ids.to_numpy()[:, None] == asked[None, :]] = -np.inf
        top = np.maximum.reduceat(sims, starts, axis=0)
        at = np.where(sims == np.repeat(top, lengths, axis=0), np.arange(len(codes))[:, None], len(codes))
        first = np.minimum.reduceat(at, starts, axis=0)
        keep = top > -np.inf
        if limit is not None and len(top) > limit:
            keep &= top >= np.partition(top, len(top) - limit, axis=0)[len(top) - limit]
        doc, query = np.nonzero(keep)
        documents = coded.dictionary.take(pa.array(codes[starts][doc]))
        yield pa.RecordBatch.from_arrays([pa.array(asked[query]), documents, ids.take(pa.array(first[doc, query])), pa.array(top[doc, query])], ["query_id", "document", "id", "sim"])


def _best_of_batches(q_ids: np.ndarray, q: np.ndarray, k: int, skip_self: bool, digits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best: list[np.ndarray] = []
    for whole in batches:
        for start in range(0, whole.num_rows, ROW_TILE):
            batch = whole.slice(start, ROW_TILE)
            column = batch.column(0)
            ids = np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) else column.to_numpy()
            x = _unit_matrix(batch.column(1), batch.num_rows)
            for at, query in enumerate(q_ids):
                if at % QUERY_TILE == 0:
                    sims = np.round(np.clip(x @ q[at : at + QUERY_TILE].T, -1.0, 1.0), digits) + 0.0
                s, i = sims[:, at % QUERY_TILE], ids
                if skip_self:
                    keep = ids != query
                    s, i = s[keep], ids[keep]
                if len(s) > k:
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    near = np.flatnonzero(s >= edge)
                    pick = near[np.lexsort((i[near], -s[near]))[:k]]
                    s, i = s[pick], i[pick]
                best.append(np.stack([np.full(len(s), at, dtype=np.float64), s]))
                best.append(i)
            if len(best) > 2 * len(q_ids):
                best = _merge_best(best, k)
    if best:
        at, s, i = _flat(best)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(i), pa.array(s)], ["query_id", "id", "sim"])


def _flat(best: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, ids = np.concatenate(best[::2], axis=1), np.concatenate(best[1::2])
    return pairs[0].astype(np.int64), pairs[1], ids


def _merge_best(best: list[np.ndarray], k: int) -> list[np.ndarray]:
    at, s, i = _flat(best)
    order = np.lexsort((i, -s, at))
    at, s, i = at[order], s[order], i[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return [np.stack([at[keep].astype(np.float64), s[keep]]), i[keep]]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query_id by similarity, then id, with their rank (int, from 1)."""
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_passages(scored: DataFrame, document: str = "source_path") -> DataFrame:
    """One passage for each query and document: the most similar, then the smallest id."""
    order = Window.partitionBy("query_id", document).orderBy(F.col("sim").desc(), F.col("id").asc())
    return scored.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def merge_bundles(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` across bundles for each query: by similarity, bundle, path and id."""
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "bundle", "source_path", "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rerank(scored: DataFrame, score: Column, k: int, candidates: int = 50) -> DataFrame:
    """Reorder the best ``max(k, candidates)`` rows of each query by ``score``, then by their old rank, and keep ``k``."""
    window = scored.filter(F.col("rank") <= max(k, candidates)).withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    return window.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k)


def rerank_with(scored: DataFrame, judge: Callable[[list[str], list[str]], np.ndarray], k: int, candidates: int = 50) -> DataFrame:
    """``rerank`` by a model: ``judge`` gets the columns query_text and content of the candidates, in batches, and returns their scores."""
    window = scored.filter(F.col("rank") <= max(k, candidates))
    names = window.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [[x or "" for x in batch.column(names.index(n)).to_pylist()] for n in ("query_text", "content")]
            found = np.asarray(judge(*said), dtype=np.float64) if batch.num_rows else np.empty(0)
            if len(found) != batch.num_rows or not np.isfinite(found).all():
                raise ValueError("a reranker returns one finite score for each candidate")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, "judged"])

    judged = window.mapInArrow(run, T.StructType([*window.schema.fields, T.StructField("judged", T.DoubleType())]))
    return rerank(judged, F.col("judged"), k, candidates).drop("judged")


def uncovered(eligible: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Eligible passages without a stored vector; a search over them would be incomplete."""
    return eligible.join(stored.select(key), key, "left_anti")


def enclosing_parents(chunks: DataFrame) -> DataFrame:
    """chunk_id and parent_id: the smallest passage of the same file that strictly encloses it.

    Passages of a file are swept in order of their lines; what is remembered are
    the passages that are open at a line, so a large file costs its length and
    not its square.  Of equal spans the later start, then the smaller id is the
    parent.
    """
    kind = dict(chunks.dtypes)["chunk_id"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            found = []
            for path, key, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if path != file:
                    file, open_ = path, []
                open_ = [x for x in open_ if x[1] >= s]
                around = [(pe - ps, -ps, parent) for ps, pe, parent in open_ if pe >= e and pe - ps > e - s]
                if around:
                    found.append((key, *min(around)))
                open_.append((s, e, key))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["chunk_id", "span", "later", "parent_id"])

    spans = chunks.select("source_path", "chunk_id", "line_start", "line_end").filter("source_path is not null")
    ordered = spans.repartition("source_path").sortWithinPartitions("source_path", "line_start", F.col("line_end").desc())
    best = F.min(F.struct("span", "later", "parent_id")).alias("b")  # an id may stand in several rows
    return ordered.mapInArrow(sweep, f"chunk_id {kind}, span long, later long, parent_id {kind}").groupBy("chunk_id").agg(best).select("chunk_id", F.col("b.parent_id").alias("parent_id"))


def symbol_parents(chunks: DataFrame) -> DataFrame:
    """chunk_id and parent_id by symbol: same file, the child's ``parent_symbol`` is the parent's ``symbol``.

    Parents that start before the child come first, then the nearest start, the
    smallest span and the smallest id.  Passages of a symbol are swept once in
    order of their starts, behind the first parent of all.  What is remembered
    are the last parent, the last one of another id, and one child that has met
    only itself, so a task needs memory for its sort alone.
    """
    keys, kind = ["source_path", "symbol"], dict(chunks.dtypes)["chunk_id"]
    head, parent, child = 0, 1, 2

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = first = last = other = waiting = None
        for batch in batches:
            found = []
            meet = lambda key, at, behind, x: found.append((key, behind, None if at is None or x[0] is None else abs(x[0] - at), x[1], x[2]))  # noqa: B023, E731
            for path, symbol, what, at, span, key in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (path, symbol):
                    group, first, last, other, waiting = (path, symbol), None, None, None, None
                if what == head:
                    first = (at, span, key)
                elif what == parent:
                    if waiting and key != waiting[0]:
                        _, place, start = waiting
                        waiting = (waiting[0], place, at) if start in (None, at) else None
                        if waiting:
                            meet(waiting[0], place, True, (at, span, key))
                    if last and last[2] != key:
                        other = last
                    last = (at, span, key)
                elif last and (last[2] != key or other):
                    meet(key, at, False, last if last[2] != key else other)
                elif first and first[2] != key:
                    meet(key, at, True, first)
                elif first:
                    waiting = (key, at, None)  # of several places the last one is nearest to what follows
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), shape.types)], schema=shape)

    start, span = F.col("line_start").cast("long").alias("at"), (F.col("line_end") - F.col("line_start")).cast("long").alias("span")
    parents = chunks.filter("symbol is not null and chunk_id is not null").select(*keys, F.lit(parent).alias("what"), start, span, F.col("chunk_id").alias("id"))
    firsts = parents.groupBy(*keys).agg(F.min(F.struct("at", "span", "id")).alias("f")).select(*keys, F.lit(head).alias("what"), "f.at", "f.span", "f.id")
    children = chunks.filter("parent_symbol is not null and chunk_id is not null").select("source_path", F.col("parent_symbol").alias("symbol"), F.lit(child).alias("what"), start, F.lit(None).cast("long").alias("span"), F.col("chunk_id").alias("id"))
    # of one start the best parent comes last, and children behind it
    order = [*keys, F.col("what") != head, "at", "what", F.desc("span"), F.desc("id")]
    swept = firsts.unionByName(parents).unionByName(children).repartition(*keys).sortWithinPartitions(*order)
    schema = f"chunk_id {kind}, behind boolean, far long, span long, parent_id {kind}"
    shape = to_arrow_schema(chunks.sparkSession.createDataFrame([], schema).schema)
    met = swept.mapInArrow(sweep, schema).groupBy("chunk_id").agg(F.min(F.struct("behind", "far", "span", "parent_id")).alias("b"))  # an id may stand in several rows
    return met.select("chunk_id", F.col("b.parent_id").alias("parent_id"))


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace hits (query_id, chunk_id, rank) by their parents where they have one; each context once, at its best rank."""
    joined = hits.join(parents, "chunk_id", "left").select("query_id", F.coalesce("parent_id", "chunk_id").alias("context_id"), "rank", F.col("parent_id").isNotNull().alias("expanded"))
    order = Window.partitionBy("query_id", "context_id").orderBy("rank")
    return joined.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def expand_links(matches: DataFrame, edges: DataFrame, first_passages: DataFrame, k: int) -> DataFrame:
    """One hop of context: for each query up to ``k`` passages of documents that its matches link to.

    matches: query_id, document, rank.  edges: source, ordinal, target.
    first_passages: document, passage_id.  Documents that are matches, or that
    an earlier match or edge brought, are not repeated.
    """
    hop = matches.join(edges, matches.document == edges.source).select("query_id", "rank", "ordinal", F.col("document").alias("via"), F.col("target").alias("document"))
    new = hop.join(matches.select("query_id", "document"), ["query_id", "document"], "left_anti").join(first_passages, "document")
    first = Window.partitionBy("query_id", "document").orderBy("rank", "ordinal", "via")
    once = new.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "ordinal", "via", "document")
    return once.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("query_id", "position", "via", "document", "passage_id")


def governing_chains(governing: dict[str, str], known: set[str] | None = None) -> dict[str, list[str]]:
    """For each document the documents that govern it, nearest first; cycles and unknown paths are refused."""
    if known is not None and (lost := (set(governing) | set(governing.values())) - known):
        raise ValueError(f"unknown paths: {sorted(lost)}")
    chains = {}
    for path in governing:
        chain, at = [], path
        while at in governing:
            at = governing[at]
            if at == path or at in chain:
                raise ValueError(f"{path} governs itself")
            chain.append(at)
        chains[path] = chain
    return chains


def with_governors(matches: DataFrame, governing: dict[str, str]) -> DataFrame:
    """Matches (query_id, document, rank) with the documents that govern them before them; each document once a query.

    Returns query_id, document and place (from 1), in order of rank, a
    governor before what it governs.
    """
    chains = governing_chains(governing)
    rows = [(d, len(c) - k, g) for d, c in chains.items() for k, g in enumerate(c)]
    steps = matches.sparkSession.createDataFrame(rows, "document string, up int, governor string") if rows else None
    own = matches.select("query_id", "rank", F.lit(1_000_000).alias("up"), "document")
    if steps is not None:
        # the map is a driver-side setting, a few rows
        above = matches.join(F.broadcast(steps), "document").select("query_id", "rank", "up", F.col("governor").alias("document"))
        own = own.unionByName(above)
    first = own.groupBy("query_id", "document").agg(F.min(F.struct("rank", "up")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.rank", "at.up", "document")
    return first.withColumn("place", F.row_number().over(order)).select("query_id", "document", "place")
