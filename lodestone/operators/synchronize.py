"""Bringing a stored index to a snapshot: what to embed, write and remove, done in one commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.buckets import BucketStore, Change, Conflict, Entry, Lease
from .passages import Embedder, embed
from .sync import changed_paths, input_hash, refuse_repeats


#: Bits of the bitmap by which rows are sifted before they are shuffled: 8 MB, whatever the number of keys.
SIFT_BITS = 1 << 26


@dataclass(frozen=True)
class Synchronized:
    """What a synchronization did.

    ``embedded`` counts passages that the encoder worked for, ``encoded`` the
    different texts that it was given, ``reused`` passages that got the vector of
    another passage with the same input; ``written`` and ``removed`` passages.
    ``chunk_buckets`` and ``vector_buckets`` are the buckets written anew.
    """

    embedded: int
    encoded: int
    reused: int
    written: int
    removed: int
    chunk_buckets: int
    vector_buckets: int
    entry: Entry


def hashed(snapshot: DataFrame) -> DataFrame:
    """``snapshot`` with ``input_hash`` in place of ``input``, and ``row_hash`` over all columns."""
    rows = snapshot.withColumn("input_hash", input_hash(F.coalesce("input", F.lit("")))).drop("input")
    return rows.withColumn("row_hash", F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256))


def planned(new: DataFrame, old: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunk_id, input_hash, writes, embeds and removes of every passage that is there or was.

    ``new`` and ``old`` have chunk_id, input_hash and row_hash, ``vectors`` the
    chunk_id and input_hash of those of the model.
    """
    a = new.select("chunk_id", "input_hash", F.col("row_hash").alias("new_row"))
    b = old.select("chunk_id", F.col("row_hash").alias("old_row"))
    c = vectors.select("chunk_id", F.col("input_hash").alias("vector_input"))
    joined = a.join(b, "chunk_id", "full_outer").join(c, "chunk_id", "left")
    here = F.col("new_row").isNotNull()
    return joined.select(
        "chunk_id", "input_hash",
        (here & ~F.col("new_row").eqNullSafe(F.col("old_row"))).alias("writes"),
        (here & ~F.col("input_hash").eqNullSafe(F.col("vector_input"))).alias("embeds"),
        (~here).alias("removes"),
    )


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``; an exact join must follow.

    A bitmap of the keys' hashes, whose size is fixed, is broadcast, so that wide
    rows that no key wants are not shuffled.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(SIFT_BITS))
    position = F.bitmap_bit_position(place)
    marks = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(marks), F.bitmap_bucket_number(place) == F.col("__bucket"))
    return found.filter(F.bit_get(byte, (position % 8).cast("int")) == 1).select(*rows.columns)


def one_of_each(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk_id and input_hash of the first of ``rows`` with each input_hash of ``wanted``."""
    slim = sifted(rows.select("chunk_id", "input_hash"), wanted, "input_hash")
    return slim.join(wanted, "input_hash", "left_semi").groupBy("input_hash").agg(F.min("chunk_id").alias("chunk_id"))


def synchronize(
    store: BucketStore, snapshot: DataFrame, bundle: str, embedder: Embedder | None = None, model: str = "word-hash",
    files: DataFrame | None = None, batch: tuple[str, int] | None = None, only_paths: DataFrame | None = None, attempts: int = 3,
) -> Synchronized:
    """Bring the passages of ``bundle`` in ``store`` to ``snapshot`` in one commit.

    ``snapshot`` has chunk_id (no repeats), bundle_id, ``input`` (the text to
    embed) and any other columns; it is read twice and must give the same rows.
    A passage is embedded if ``model`` has no vector of its input under its id;
    a vector of the same input under another id is taken over, and equal texts
    are encoded once.  A change of other columns writes the passage and leaves
    its vector.  Passages of the bundle that the snapshot lacks go, with their
    vectors; other bundles stay, and their ids are refused.

    ``only_paths`` (source_path) confines it to passages of these paths, for a
    stream's batch; ``batch`` makes it happen once.  ``files`` (path, digest) is
    the inventory that the snapshot was made from.  Where another writer commits
    meanwhile everything is planned anew, ``attempts`` times at most.
    """
    refuse_repeats(snapshot, "chunk_id")
    with store.writing():
        for attempt in range(attempts):
            try:
                return _once(store, snapshot, bundle, embedder or Embedder(), model, files, batch, only_paths)
            except Conflict:
                if attempt == attempts - 1:
                    raise
    raise ValueError("attempts is 1 or more")


def _once(store: BucketStore, snapshot: DataFrame, bundle: str, embedder: Embedder, model: str, files: DataFrame | None, batch: tuple[str, int] | None, only_paths: DataFrame | None) -> Synchronized:
    base = store.current()
    if batch and base.batches.get(batch[0], -1) >= batch[1]:
        return Synchronized(0, 0, 0, 0, 0, 0, 0, base)
    new = hashed(snapshot)
    empty = new.select("chunk_id", "input_hash").limit(0)
    stored = store.read("chunks", base) if "chunks" in base.schemas else new.limit(0)
    vectors = store.read("vectors", base).filter(F.col("model") == model) if "vectors" in base.schemas else empty.withColumn("model", F.lit(model)).withColumn("vector", F.lit(None).cast("array<float>"))
    own = stored.filter(F.col("bundle_id") == bundle)
    if only_paths is not None:
        own = own.join(only_paths.select("source_path").distinct(), "source_path", "left_semi")
    foreign = new.filter(~F.col("bundle_id").eqNullSafe(F.lit(bundle))).limit(1).count() or stored.filter(F.col("bundle_id") != bundle).join(new.select("chunk_id"), "chunk_id", "left_semi").limit(1).count()
    if foreign:
        raise ValueError("a passage belongs to another bundle")
    actions = written(planned(new, own, vectors), "actions")

    # vectors: those of the same input under other ids, and what the encoder makes of the rest; hashes and ids
    # choose the rows first, then a text or vector that is wanted is shuffled once, without a sort, and no other
    pending = actions.filter("embeds").select("chunk_id", "input_hash")
    if pending.limit(1).count():
        wanted = pending.select("input_hash").distinct()
        sources = written(one_of_each(vectors, wanted), "known-sources")
        known = written(sifted(vectors.select("chunk_id", "vector"), sources, "chunk_id").join(sources.hint("shuffle_hash"), "chunk_id").select("input_hash", "vector"), "known-vectors")
        firsts = written(pending.join(sources, "input_hash", "left_anti").groupBy("input_hash").agg(F.min("chunk_id").alias("chunk_id")), "fresh-ids")
        inputs = sifted(snapshot.select("chunk_id", F.coalesce("input", F.lit("")).alias("input")), firsts, "chunk_id")
        texts = inputs.join(firsts.hint("shuffle_hash"), "chunk_id").select(F.struct("chunk_id", "input_hash").alias("key"), "input")
        fresh = written(embed(texts, "key", "input", embedder.documents).select("key.*", "vector"), "fresh-vectors")
        rest = pending.join(firsts.select("chunk_id"), "chunk_id", "left_anti")
        both = known.unionByName(sifted(fresh.drop("chunk_id"), rest, "input_hash"))
        new_vectors = rest.join(both, "input_hash").select("chunk_id", "input_hash", "vector").unionByName(fresh)
        new_vectors = new_vectors.select("chunk_id", F.lit(model).alias("model"), "input_hash", "vector")
        encoded = fresh.count()
    else:
        new_vectors, sources, encoded = None, pending.limit(0), 0

    rows = new.join(actions.filter("writes").select("chunk_id"), "chunk_id", "left_semi")
    gone = actions.filter("removes").select("chunk_id")
    changes = {"chunks": Change(rows, gone), "vectors": Change(new_vectors, gone)}
    if files is not None:
        changes["files"] = _file_change(store, base, files)
    entry = store.commit(changes, base, batch)
    fresh_flag = F.col("embeds") & F.col("is_known").isNull()
    n = lambda c: F.count(F.when(c, 1))
    marked = actions.join(sources.select("input_hash", F.lit(True).alias("is_known")), "input_hash", "left")
    counts = marked.agg(n(fresh_flag).alias("embedded"), n(F.col("embeds") & F.col("is_known")).alias("reused"), n(F.col("writes")).alias("written"), n(F.col("removes")).alias("removed")).first()
    buckets = (store.rewritten(part, base, entry) for part in ("chunks", "vectors"))
    return Synchronized(counts.embedded, encoded, counts.reused, counts.written, counts.removed, *buckets, entry)


def _file_change(store: BucketStore, base: Entry, files: DataFrame) -> Change:
    """What brings the stored inventory to ``files`` (path, digest): only paths that differ."""
    live = files.select("path", "digest")
    if "files" not in base.schemas:
        return Change(live)
    changed = written(changed_paths(store.read("files", base), live), "changed-files")
    return Change(live.join(changed.filter("change <> 'removed'"), "path", "left_semi"), changed.filter("change = 'removed'").select("path"))


class IndexUnusable(RuntimeError):
    """The index is missing or stale, and nothing is under way that mends it."""


@dataclass
class Serving:
    """A lease to read from, the paths that changed since (path, change), and whether a refresh is under way."""

    lease: Lease
    changed: DataFrame
    n_changed: int
    refreshing: bool

    def marked(self, results: DataFrame, path: str = "source_path") -> DataFrame:
        """``results`` with ``source_changed``: whether a row's file is no longer what was indexed."""
        seen = self.changed.select(F.col("path").alias(path), F.lit(True).alias("__changed"))
        return results.join(seen, path, "left").withColumn("source_changed", F.coalesce("__changed", F.lit(False))).drop("__changed")

    def notices(self) -> list[str]:
        """Codes of what a reader of the results should know."""
        return (["refresh-in-progress"] if self.refreshing else []) + (["source-changed"] if self.refreshing and self.n_changed else [])

    def __enter__(self) -> Serving:
        return self

    def __exit__(self, *_) -> None:
        self.lease.release()


def serve(store: BucketStore, live: Callable[[], DataFrame], while_refreshing: bool = False, seconds: float = 3600) -> Serving:
    """Pin the index for a search, if it may be searched.

    ``live`` gives the present inventory (path, digest).  A stale index is
    refused, unless ``while_refreshing`` is set and a writer is at work: then the
    last commit is served and its rows can be marked.  A writer may have
    committed between the pin and the assessment, so before a refusal the current
    entry is looked up again and, if it moved, all is done once more.
    """
    for attempt in range(2):
        lease = store.pin(seconds)
        try:
            known = lease.read("files") if "files" in lease.entry.schemas else None
            changed = written(changed_paths(known, live()), "changed-files") if known is not None else None
            n = changed.count() if changed is not None else 0
            refreshing = while_refreshing and store.is_refreshing()
            if changed is not None and (not n or refreshing):
                return Serving(lease, changed, n, refreshing)
            if attempt or lease.is_current():
                raise IndexUnusable("index-missing" if known is None else "index-stale")
        except BaseException:
            lease.release()
            raise
        lease.release()
    raise AssertionError("the second attempt returns or raises")
