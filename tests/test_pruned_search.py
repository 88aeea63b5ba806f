"""Search by cells against brute force over all rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import pruned_search as ps
from lodestone.operators import search as se


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v) for k, v in enumerate(x.tolist())], "id long, vector array<double>")


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.sim, 6)) for r in df.collect())


def clustered(pick, n, size, clusters, spread):
    centres = pick.normal(size=(clusters, size))
    return centres[pick.integers(0, clusters, n)] + spread * pick.normal(size=(n, size))


@pytest.mark.parametrize("kind", ["clustered", "uniform", "repeated"])
def test_results_are_those_of_a_whole_search(spark, kind):
    pick = np.random.default_rng(3)
    x = {"clustered": lambda: clustered(pick, 1200, 16, 12, 0.1), "uniform": lambda: pick.normal(size=(800, 6)), "repeated": lambda: clustered(pick, 40, 4, 3, 0.1)[pick.integers(0, 40, 900)]}[kind]()
    v = frame(spark, x)
    q = v.filter("id % 20 = 0")
    got = ps.nearest_pruned(ps.build(v, 24), q, 5)
    assert rows(got.found) == rows(se.nearest(v, q, 5))
    assert 0 <= got.skipped <= 1 and (kind != "clustered" or got.skipped > 0.5)


def test_odd_vectors_and_few_rows(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1e-9], [-1.0, 0.0], [1e300, 1e300], [0.0, 0.0], [-1e-300, 0.0]])
    v = frame(spark, x)
    for k in (1, 3, 20):
        for n in (1, 3):
            assert rows(ps.nearest_pruned(ps.build(v, n), v, k).found) == rows(se.nearest(v, v, k))
    assert rows(ps.nearest_pruned(ps.build(v, 2), v, 3, skip_self=False).found) == rows(se.nearest(v, v, 3, skip_self=False))
    none = v.limit(0)
    assert ps.nearest_pruned(ps.build(none, 3), v, 3).found.collect() == [] and ps.nearest_pruned(ps.build(v, 3), none, 3).skipped == 0.0
    only_zero = v.filter("id in (0, 5)")
    assert rows(ps.nearest_pruned(ps.build(only_zero, 3), v, 3).found) == rows(se.nearest(only_zero, v, 3))
    with pytest.raises(ValueError):
        ps.build(v.withColumn("vector", F.lit(None).cast("array<double>")), 3)
    with pytest.raises(ValueError):
        ps.build(v, 0)


def test_a_hot_cell_is_cut_into_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ps, "ROW_BLOCK", 100)
    monkeypatch.setattr(ps, "QUERY_BLOCK", 7)
    v = frame(spark, clustered(np.random.default_rng(1), 700, 8, 2, 0.05))
    q = v.filter("id % 20 = 0")
    assert rows(ps.nearest_pruned(ps.build(v, 4), q, 6).found) == rows(se.nearest(v, q, 6))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 6))
def test_no_row_beats_its_cells_bound(seed, size):
    pick = np.random.default_rng(seed)
    x, q = ps.unit_rows(pick.normal(size=(40, size))), ps.unit_rows(pick.normal(size=(5, size)))
    centre = ps.unit_rows(x.mean(axis=0)[None, :])
    radius = ps.angles(x, centre).max() + ps.SLACK
    bound = np.cos(np.maximum(0.0, ps.angles(q, centre)[:, 0] - radius))
    assert ((q @ x.T).max(axis=1) <= bound + 1e-9).all()


@pytest.mark.parametrize("by_document", [False, True])
def test_a_task_holds_few_similarities_at_once(by_document):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4096, 16)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(list(x), pa.list_(pa.float32())), pa.array(np.arange(4096) % 7)], ["id", "vector", "document"])
    unit, ids = se.unit_rows(x), np.arange(4096)
    tracemalloc.start()
    found = list(se._best_of_documents(ids, unit, True, 6, batch.slice(0, 2048), 2) if by_document else se._best_of_batches(ids, unit, 2, True, 6, iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 4096 queries with 2048 rows are 67 MB a matrix
    assert {i for b in found for i in b.column(0).to_pylist()} == set(range(4096))
