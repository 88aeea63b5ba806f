"""The bucket store, synchronization, serving and continuous ingestion."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import synchronize as sn
from lodestone.operators.passages import Embedder, hash_vectors
from lodestone.sources.buckets import BucketStore, Change, Conflict, Damaged
from lodestone.sources.files import Files, Marks
from lodestone.streaming import ingest as ig

SNAPSHOT = "chunk_id string, bundle_id string, source_path string, title string, input string"


def snapshot(spark, rows, bundle="b"):
    return spark.createDataFrame([(i, bundle, p, t, x) for i, p, t, x in rows], SNAPSHOT)


def counts(done):
    return done.embedded, done.encoded, done.reused, done.written, done.removed


def counting(path):
    """An encoder that notes how many texts it was given, in a file, for it runs in workers; and what reads the number."""

    def encode(texts):
        with open(path, "a") as f:
            f.write("x" * len(texts))
        return hash_vectors(texts, 16)

    return encode, lambda: path.stat().st_size if path.exists() else 0


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, f"file://{tmp_path}/store", n_buckets=16)


def test_a_name_is_taken_once_with_its_whole_text(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/f")
    assert files.put_once("entries/1", "first") and not files.put_once("entries/1", "second") and files.text("entries/1") == "first"
    files._drafted("entries/2", "a writer that was lost before its rename")
    assert [x.name for x in files.listed("entries")] == ["1"] and files.put_once("entries/2", "other") and files.text("entries/2") == "other"
    files.write("a", "1")
    files.write("a", "2")
    assert files.text("a") == "2" and files.text("none") is None and files.listed("none") == [] and not files.delete("none")
    marks = Marks(files, "marks")
    marks.set("past", -1)
    marks.set("held", 60)
    assert marks.held() == ["held"] and [x.name for x in files.listed("marks")] == ["held"]


def test_synchronize_embeds_writes_and_removes_what_changed(spark, store, tmp_path):
    encoder, n_encoded = counting(tmp_path / "encoded")
    sync = lambda rows, bundle="b": sn.synchronize(store, snapshot(spark, rows, bundle), bundle, Embedder(documents=encoder))
    rows = [(f"c{k}", f"p{k % 10}", "t", f"text {k}") for k in range(60)] + [("same", "p1", "t", "text 1"), ("none", "p1", None, None)]
    assert counts(sync(rows)) == (62, 61, 0, 62, 0) and n_encoded() == 61
    other = [(f"o{k}", "p", "t", f"text {k}") for k in range(5)]
    done = sync(other, "other")
    assert counts(done) == (0, 0, 5, 5, 0) and n_encoded() == 61  # inputs that the store has vectors of
    assert (store.current().rows("chunks"), store.current().rows("vectors")) == (67, 67)
    same = sync(rows)
    assert counts(same) == (0, 0, 0, 0, 0) and same.entry.number == done.entry.number  # nothing is committed
    # metadata of one passage: its bucket is written anew, no vector is
    titled = [r if r[0] != "c7" else ("c7", "p7", "new title", "text 7") for r in rows]
    done = sync(titled)
    assert counts(done) == (0, 0, 0, 1, 0) and (done.chunk_buckets, done.vector_buckets) == (1, 0) and n_encoded() == 61
    # one text changes, one passage goes, one moves to another id
    moved = [("c8", "p8", "t", "another text")] + [("moved", p, t, x) if i == "c9" else (i, p, t, x) for i, p, t, x in titled if i not in ("c8", "c10")]
    done = sync(moved)
    assert counts(done) == (1, 1, 1, 2, 2) and done.chunk_buckets <= 4 and done.vector_buckets <= 4 and n_encoded() == 62
    got = {r.chunk_id: (r.title, r.bundle_id) for r in store.read("chunks").collect()}
    assert got == {i: (t, "b") for i, _, t, _ in moved} | {i: ("t", "other") for i, *_ in other}
    vectors = {r.chunk_id: r.vector for r in store.read("vectors").collect()}
    want = {i: x or "" for i, _, _, x in moved + other}
    texts = sorted(set(want.values()))
    by_text = {t: v.astype("float32").tolist() for t, v in zip(texts, hash_vectors(texts, 16))}
    assert vectors == {i: by_text[x] for i, x in want.items()}
    store.verify()
    assert counts(sync([])) == (0, 0, 0, 0, 61) and store.current().rows("chunks") == 5


def test_another_model_gets_vectors_of_its_own(spark, store):
    rows = snapshot(spark, [("a", "p", "t", "x"), ("b", "p", "t", "y")])
    sn.synchronize(store, rows, "b", model="one")
    done = sn.synchronize(store, rows, "b", model="two")
    assert counts(done) == (2, 2, 0, 0, 0) and done.chunk_buckets == 0
    assert sorted((r.chunk_id, r.model) for r in store.read("vectors").collect()) == [("a", "one"), ("a", "two"), ("b", "one"), ("b", "two")]


def test_what_a_store_refuses(spark, store):
    base = sn.synchronize(store, snapshot(spark, [("a", "p", "t", "x")]), "b").entry
    with pytest.raises(ValueError, match="another bundle"):
        sn.synchronize(store, snapshot(spark, [("a", "p", "t", "x")], "c"), "c")
    with pytest.raises(ValueError, match="another bundle"):
        sn.synchronize(store, snapshot(spark, [("z", "p", "t", "x")], "c"), "b")
    with pytest.raises(ValueError, match="repeat"):
        sn.synchronize(store, snapshot(spark, [("z", "p", "t", "x"), ("z", "p", "t", "y")]), "b")
    vector = lambda *rows: {"vectors": Change(spark.createDataFrame(rows, "chunk_id string, model string, input_hash string, vector array<float>"))}
    for bad in (None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]):
        with pytest.raises(ValueError, match="null, empty, zero or not finite"):
            store.commit(vector(("a", "m", "h", bad)), base)
    with pytest.raises(ValueError, match="length"):
        store.commit(vector(("a", "m", "h", [1.0]), ("b", "m", "h", [1.0, 2.0])), base)
    with pytest.raises(ValueError, match="no chunk"):
        store.commit(vector(("b", "m", "h", [1.0])), base)
    with pytest.raises(ValueError, match="repeat a key"):
        store.commit(vector(("a", "m", "h", [1.0]), ("a", "m", "h", [2.0])), base)
    with pytest.raises(ValueError, match="without a key"):
        store.commit(vector((None, "m", "h", [1.0])), base)
    assert store.current() == base
    with pytest.raises(LookupError):
        BucketStore(spark, store.root + "-none").read("chunks")


def test_of_two_writers_one_plans_again(spark, store, monkeypatch):
    sn.synchronize(store, snapshot(spark, [("a", "p", "t", "x")]), "b")
    stale = store.current()
    sn.synchronize(store, snapshot(spark, [("a", "p", "t", "x"), ("b", "p", "t", "y")]), "b")
    with pytest.raises(Conflict):
        store.commit({part: Change(removed=spark.createDataFrame([("a",)], "chunk_id string")) for part in ("chunks", "vectors")}, stale)
    plain, seen = store.current, []
    monkeypatch.setattr(store, "current", lambda: seen.append(1) or (stale if len(seen) == 1 else plain()))
    done = sn.synchronize(store, snapshot(spark, [("a", "p", "t", "x"), ("b", "p", "t", "y"), ("c", "p", "t", "z")]), "b")
    assert counts(done) == (1, 1, 0, 1, 0) and store.current().rows("chunks") == 3  # b was there at the second try


def test_a_pinned_entry_outlives_commits_and_collections(spark, store):
    rows = [(f"c{k}", "p", "t", f"text {k}") for k in range(40)]
    sn.synchronize(store, snapshot(spark, rows), "b")
    with store.pin(60) as lease:
        lazy = lease.read("chunks").filter("title = 't'")
        sn.synchronize(store, snapshot(spark, [(i, p, "u", x + "!") for i, p, _, x in rows]), "b")
        assert not lease.is_current() and store.collect_garbage() == []
        assert lazy.count() == 40 and lease.read("vectors").count() == 40
        lease.renew(-1)  # its time is over
        assert len(store.collect_garbage()) > 0
        with pytest.raises(Exception):
            lease.read("chunks").collect()
    assert store.read("chunks").filter("title = 'u'").count() == 40 and store.collect_garbage() == []
    sn.synchronize(store, snapshot(spark, rows[:1]), "b")
    assert store.collect_garbage(grace_seconds=3600) == [] and store.collect_garbage() != []
    store.verify()
    assert store.forget() and not store.forget()


def test_staged_and_lost_commits_are_collected_in_time(spark, store):
    sn.synchronize(store, snapshot(spark, [("a", "p", "t", "x")]), "b")
    spark.range(3).write.parquet(f"{store.root}/data/{5:010d}-under-way/chunks/bucket=1")
    spark.range(3).write.parquet(f"{store.root}/data/{1:010d}-lost-the-race/chunks/bucket=1")
    assert store.collect_garbage() == [f"data/{1:010d}-lost-the-race"]
    assert store.collect_garbage(staged_seconds=0) == [f"data/{5:010d}-under-way"]
    store.verify()


def test_damage_is_seen(spark, store):
    entry = sn.synchronize(store, snapshot(spark, [(f"c{k}", "p", "t", f"text {k}") for k in range(20)]), "b").entry
    bucket = next(iter(entry.buckets["chunks"].values()))
    store.files.delete(bucket.folder)
    store.read("chunks", entry, {1}).limit(0).write.parquet(f"{store.root}/{bucket.folder}")
    with pytest.raises(Damaged):
        store.verify()


def test_serving_while_refreshing(spark, store):
    live = {"p0": "d0", "p1": "d1"}
    files = lambda: spark.createDataFrame(list(live.items()), "path string, digest string")
    with pytest.raises(sn.IndexUnusable, match="missing"):
        sn.serve(store, files)
    rows = [("a", "p0", "t", "x"), ("b", "p1", "t", "y")]
    sn.synchronize(store, snapshot(spark, rows), "b", files=files())
    with sn.serve(store, files) as serving:
        assert serving.notices() == [] and not serving.marked(serving.lease.read("chunks")).filter("source_changed").count()
    assert store.leases.held() == []
    live["p1"] = "edited"
    with pytest.raises(sn.IndexUnusable, match="stale"):
        sn.serve(store, files, while_refreshing=True)
    with store.writing(60):
        with pytest.raises(sn.IndexUnusable, match="stale"):
            sn.serve(store, files)
        with sn.serve(store, files, while_refreshing=True) as serving:
            assert serving.notices() == ["refresh-in-progress", "source-changed"]
            assert {r.chunk_id: r.source_changed for r in serving.marked(serving.lease.read("chunks")).collect()} == {"a": False, "b": True}
    # a commit between the pin and the look at the files: all is done once more
    plain = files
    calls = []

    def late():
        if not calls:
            calls.append(1)
            sn.synchronize(store, snapshot(spark, rows), "b", files=plain())
        return plain()

    with sn.serve(store, late) as serving:
        assert serving.n_changed == 0 and serving.lease.is_current()
    assert store.leases.held() == []


DOC = "source_path string, version long, content_type string, text string, deleted boolean"


def test_a_stream_follows_the_latest_versions(spark, store, tmp_path):
    source, step = tmp_path / "in", iter(range(99))

    def feed(*rows, retention=3600):
        spark.createDataFrame([(p, v, "text", t, d) for p, v, t, d in rows], DOC).coalesce(1).write.parquet(f"file://{source}/{next(step)}")
        stream = spark.readStream.schema(DOC).parquet(f"file://{source}/*")
        query = ig.ingest(stream, store, "b", f"file://{tmp_path}/check", retention=retention)
        query.awaitTermination()
        return {r.source_path: r.content for r in store.read("chunks").collect()}

    assert feed(("a", 1, "one", False), ("b", 5, "five", False), ("b", 4, "four", False), (None, 1, "x", False)) == {"a": "one", "b": "five"}
    assert feed(("b", 3, "late", False), ("a", 2, "two", None)) == {"a": "two", "b": "five"}
    assert feed(("b", 6, None, True)) == {"a": "two"}
    assert feed(("b", 5, "older than its deletion", False)) == {"a": "two"}
    assert feed(("b", 7, "made again", False)) == {"a": "two", "b": "made again"}
    assert feed(("a", 3, "left", False), ("a", 3, "right", False)) == {"a": "right", "b": "made again"}  # one version, two texts
    # a batch that is replayed
    entry = store.current()
    batch = spark.createDataFrame([("a", 9, "text", "replayed", False)], DOC)
    ig.apply(store, batch, entry.batches["ingest"], "b", "ingest")
    assert store.current() == entry
    ig.apply(store, batch, entry.batches["ingest"] + 1, "b", "ingest")
    assert store.current().number == entry.number + 1 and store.read("vectors").count() == 2


def test_tombstones_are_cleared_in_time(spark, store, tmp_path):
    def feed(n, *rows):
        spark.createDataFrame([(p, v, "text", t, d) for p, v, t, d in rows], DOC).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        ig.ingest(spark.readStream.schema(DOC).parquet(f"file://{tmp_path}/in/*"), store, "b", f"file://{tmp_path}/check", retention=0.5).awaitTermination()
        return {r.source_path for r in store.read("chunks").collect()}

    assert feed(1, ("a", 2, "x", False), ("k", 1, "x", False)) == {"a", "k"}
    assert feed(2, ("a", 3, None, True)) == {"k"}
    time.sleep(1)
    assert feed(3, ("k", 2, "y", False)) == {"k"}  # the timer runs in this batch
    assert feed(4, ("a", 1, "older, but nothing remembers", False)) == {"a", "k"}


def test_texts_are_shuffled_once_and_only_where_embedded(spark, store):
    import random

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    made = random.Random(3)
    rows = [(f"c{k}", "b", f"p{k}", made.randbytes(10_000).hex()) for k in range(150)]
    rows += [("copy", "b", "p", rows[0][3]), ("empty", "b", "p", None)]
    docs = sn.written(spark.createDataFrame(rows, "chunk_id string, bundle_id string, source_path string, input string"), "snapshot")
    size, before = sum(len(r[3] or "") for r in rows), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = []
        for _ in range(2):
            start = shuffled()
            done = sn.synchronize(store, docs, "b")
            steps.append((shuffled() - start, done.embedded, done.encoded, done.reused, done.written))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert steps[0][1:] == (152, 151, 0, 152) and steps[1][1:] == (0, 0, 0, 0)
    assert steps[0][0] < 1.5 * size and steps[1][0] < 0.1 * size, (steps, size)
    assert {r.chunk_id for r in store.read("vectors").collect()} == {r[0] for r in rows}
    keys = spark.range(7, 150, 9).selectExpr("concat('c', id) as chunk_id")
    left = {r.chunk_id for r in sn.sifted(docs, keys, "chunk_id").collect()}
    assert left >= {r.chunk_id for r in keys.collect()} and len(left) < 20
