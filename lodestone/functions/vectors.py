"""Vector functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row: inside a lambda a plain expression is computed again for each entry."""
    return F.transform(F.array(value), body)[0]


def max_abs(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))


def unit(v: Column) -> Column:
    """``v`` scaled by its largest absolute value, then to length 1; null for a zero vector.

    Scaling first keeps squares of very large and very small entries finite.
    """
    length = lambda scaled: F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    by_length = lambda scaled: _bound(length(scaled), lambda n: F.transform(scaled, lambda x: x / n))
    by_top = lambda top: F.when(top > 0, _bound(F.transform(v, lambda x: x.cast("double") / top), by_length))
    return _bound(max_abs(v), by_top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; 0 if either vector is zero."""
    # greatest and least skip nulls, so a zero vector's null goes first
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(dot(unit(a), unit(b)), F.lit(0.0))))


def refuse_bad_vectors(vectors: DataFrame) -> None:
    """Raise ValueError if a ``vector`` is null, empty, zero or not finite, or if vectors of one ``model`` differ in length."""
    v = F.col("vector")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall(v, lambda x: x == 0)
    if vectors.filter(bad).limit(1).count():
        raise ValueError("a vector is null, empty, zero or not finite")
    lengths = vectors.groupBy("model").agg(F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("most")).filter("least <> most")
    if lengths.limit(1).count():
        raise ValueError("vectors of one model differ in length")


def checked_cosine(a: Column, b: Column) -> Column:
    """``cosine``, which fails the job on vectors that are null, empty, of different lengths or not finite."""
    odd = lambda v: v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    refused = odd(a) | odd(b) | (F.size(a) != F.size(b))
    return F.when(refused, F.raise_error(F.lit("vectors without a similarity")).cast("double")).otherwise(cosine(a, b))


def similarity_of_distance(distance: Column) -> Column:
    """Similarity of a cosine distance, clamped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` as unit vectors in double precision; zero rows stay zero."""
    x = np.asarray(x, dtype=np.float64)
    top = np.abs(x).max(axis=1, keepdims=True) if x.size else np.zeros((len(x), 1))
    x = x / np.where(top > 0, top, 1)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)
