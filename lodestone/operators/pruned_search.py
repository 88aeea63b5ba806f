"""Exact vector search that skips what cannot be among the best.

Vectors are dealt into cells around fitted centroids, and each cell keeps the
largest angle from its centroid.  A first round searches a query's nearest cells
and finds how good its ``k``-th best is at least; by the triangle inequality of
angles no row of a cell is nearer to the query than the angle to the centroid
less the cell's radius, so a second round visits only cells that can beat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import unit_rows
from ..session import written
from .search import QUERY_BLOCK, ROW_BLOCK, ROW_TILE, _best_of_batches, _unit_matrix, check_vectors, top_k

#: Rows, drawn by hash, that centroids are fitted on, and cells at most.
SAMPLE, MAX_CELLS = 20_000, 4096
#: Added to each cell's radius, for the rounding of angles.
SLACK = 1e-6
#: The cell of zero vectors, which have no direction; it is never skipped.
NO_DIRECTION = -1


@dataclass(frozen=True)
class Cells:
    """Written rows (id, vector, cell), and of each cell its centroid, radius (angle) and number of rows."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    n_without: int


def fit_centroids(vectors: DataFrame, n_cells: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Directions of at most ``n_cells`` cells, by spherical k-means on at most ``sample`` rows.

    Where they lie decides how much is skipped, not what is found.
    """
    drawn = vectors.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    x = _unit_matrix(drawn, len(drawn)) if len(drawn) else np.empty((0, 1))
    x = np.unique(x[np.abs(x).sum(axis=1) > 0], axis=0)
    if not len(x):
        return x
    at = x[np.linspace(0, len(x) - 1, min(n_cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ at.T, axis=1)
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        moved = unit_rows(total)
        at = np.where((np.abs(moved).sum(axis=1) > 0)[:, None], moved, at)
    return at


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def build(vectors: DataFrame, n_cells: int = 64) -> Cells:
    """Deal ``vectors`` (id, vector) into cells and write them; bad vectors are refused as ``check_vectors`` does."""
    if not 1 <= n_cells <= MAX_CELLS:
        raise ValueError(f"n_cells is 1 to {MAX_CELLS}")
    check_vectors(vectors)
    centroids = fit_centroids(vectors, n_cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_TILE):
                part = batch.slice(start, ROW_TILE)
                x = _unit_matrix(part.column(1), part.num_rows)
                apart = angles(x, centroids) if len(centroids) else np.zeros((len(x), 1))
                cell, angle = apart.argmin(axis=1), apart.min(axis=1)
                cell[np.abs(x).sum(axis=1) == 0] = NO_DIRECTION
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "vector", "cell", "angle"])

    kinds = dict(vectors.dtypes)
    rows = written(vectors.select("id", "vector").mapInArrow(run, f"id {kinds['id']}, vector {kinds['vector']}, cell int, angle double"), "cells")
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    without = 0
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # MAX_CELLS at most
        if r.cell == NO_DIRECTION:
            without = r.n
        else:
            radius[r.cell], size[r.cell] = r.radius + SLACK, r.n
    return Cells(rows.drop("angle"), centroids, radius, size, without)


def _planned(queries: DataFrame, cells: Cells, k: int, digits: int) -> DataFrame:
    """id, vector, cell and round of the cells to search: round 1 holds ``k`` rows and more, round 2 has what the bound leaves.

    ``queries`` have a ``least`` similarity of their k-th best, or null before
    the first round; then the nearest cells are meant.
    """
    centroids, radius, size = cells.centroids, cells.radius, cells.size
    extra = [NO_DIRECTION] if cells.n_without else []
    margin = 0.5 * 10.0**-digits + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_TILE):
                part = batch.slice(start, ROW_TILE)
                x = _unit_matrix(part.column(1), part.num_rows)
                least = part.column(2).to_numpy(zero_copy_only=False)
                apart = angles(x, centroids) if len(centroids) else np.zeros((len(x), 0))
                order = np.argsort(apart, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(apart.shape, dtype=bool)
                np.put_along_axis(first, order, before < k + 1, axis=1)  # one more than k: a query may be a row itself
                bound = np.cos(np.maximum(0.0, apart - radius))
                bound[np.abs(x).sum(axis=1) == 0] = 1.0
                now = np.isnan(least)[:, None]
                wanted = np.where(now, first, ~first & (bound + margin >= np.nan_to_num(least, nan=2.0)[:, None])) & (size > 0)
                row, cell = np.nonzero(wanted)
                if extra:
                    both = np.flatnonzero(np.isnan(least))
                    row, cell = np.concatenate([row, both]), np.concatenate([cell, np.full(len(both), NO_DIRECTION)])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(cell.astype(np.int32))], ["id", "vector", "cell"])

    kinds = dict(queries.dtypes)
    return queries.select("id", "vector", F.col("least").cast("double").alias("least")).mapInArrow(run, f"id {kinds['id']}, vector {kinds['vector']}, cell int")


def _searched(cells: Cells, planned: DataFrame, k: int, skip_self: bool, digits: int) -> DataFrame:
    """query_id, id and sim of the best ``k`` of each query in each part of the planned cells.

    Cells are cut into parts of ``ROW_BLOCK`` rows and their queries into blocks
    of ``QUERY_BLOCK``, so a cell of any size, with any number of queries, is
    dealt over tasks.
    """
    spark = cells.rows.sparkSession
    asked = planned.groupBy("cell").agg(F.count("*").alias("asked"))
    n = spark.createDataFrame([(c, int(s)) for c, s in [*enumerate(cells.size.tolist()), (NO_DIRECTION, cells.n_without)]], "cell int, n long")
    shape = F.broadcast(asked.join(F.broadcast(n), "cell").select("cell", F.ceil(F.col("n") / ROW_BLOCK).alias("tiles"), F.ceil(F.col("asked") / QUERY_BLOCK).alias("blocks")))  # MAX_CELLS rows
    left = cells.rows.join(shape, "cell").select("cell", F.pmod(F.xxhash64("id"), "tiles").alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "vector")
    right = planned.join(shape, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id", "vector")
    schema = f"query_id long, id {dict(cells.rows.dtypes)['id']}, sim double"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def pair(some: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([], schema=arrow)
        if not some.num_rows or not queries.num_rows:
            return empty
        q = _unit_matrix(queries.column("vector").combine_chunks(), queries.num_rows)
        out = list(_best_of_batches(queries.column("id").to_numpy(), q, k, skip_self, digits, iter(some.select(["id", "vector"]).combine_chunks().to_batches())))
        return pa.Table.from_batches([b.cast(arrow) for b in out]) if out else empty

    keys = ["cell", "tile", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, schema)


@dataclass(frozen=True)
class Pruned:
    """query_id, id, sim and rank of what was found, and the share of pairs of queries and rows that were not scored."""

    found: DataFrame
    skipped: float


def nearest_pruned(cells: Cells, queries: DataFrame, k: int, skip_self: bool = True, digits: int = 6) -> Pruned:
    """The rows that ``search.nearest`` gives for ``queries`` (id long, no repeats; vector), found in two rounds.

    Ties at the rounding of ``digits`` are kept whole: a cell is skipped only if
    its bound is below the threshold by more than the rounding.  Zero vectors
    are searched by every query, and a zero query searches every cell.
    """
    check_vectors(queries, cells.rows)
    asked = queries.select(F.col("id").cast("long").alias("id"), "vector")
    near = written(_planned(asked.withColumn("least", F.lit(None)), cells, k, digits), "near-cells")
    first = written(_searched(cells, near, k, skip_self, digits), "first-round")
    least = top_k(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("sim")).otherwise(-2.0).alias("least"))
    bounded = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
    far = written(_planned(bounded, cells, k, digits), "far-cells")
    found = top_k(first.unionByName(_searched(cells, far, k, skip_self, digits)), k)
    sizes = {**dict(enumerate(cells.size.tolist())), NO_DIRECTION: cells.n_without}
    visits = near.unionByName(far).groupBy("cell").count().collect()
    total = asked.count() * (int(cells.size.sum()) + cells.n_without)
    return Pruned(found, 1 - sum(r["count"] * sizes[r.cell] for r in visits) / total if total else 0.0)
