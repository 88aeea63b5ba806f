"""An index store that rewrites only what changes, and whose readers keep what they read.

Rows lie in buckets of their key's hash.  An entry (a numbered file, taken once)
names for each bucket the folder that holds its rows, their number and a digest.
A commit writes the touched buckets anew, below a folder of its own, and takes
the next entry, which names the untouched ones where they are.  A reader pins an
entry by a lease; garbage collection deletes folders that no current, pinned or
recent entry names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.vectors import refuse_bad_vectors
from .files import Files, Marks

#: The parts of an index and the columns that tell their rows apart; the first one makes the bucket.
PARTS = {"chunks": ("chunk_id",), "vectors": ("chunk_id", "model"), "files": ("path",)}


class Conflict(RuntimeError):
    """Another writer committed meanwhile: what was planned on the older entry must be planned again."""


class Damaged(ValueError):
    """A bucket's rows are not those that its entry names."""


@dataclass(frozen=True)
class Bucket:
    folder: str
    rows: int
    digest: str


@dataclass(frozen=True)
class Entry:
    """Number, number of buckets, buckets and schema of each part, and the last batch of each stream."""

    number: int
    n_buckets: int
    buckets: dict[str, dict[int, Bucket]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        parts = {p: {k: [b.folder, b.rows, b.digest] for k, b in x.items()} for p, x in self.buckets.items()}
        return json.dumps({"n_buckets": self.n_buckets, "buckets": parts, "schemas": self.schemas, "batches": self.batches})

    @staticmethod
    def parse(number: int, text: str) -> Entry:
        x = json.loads(text)
        return Entry(number, x["n_buckets"], {p: {int(k): Bucket(*b) for k, b in y.items()} for p, y in x["buckets"].items()}, x["schemas"], x["batches"])

    def rows(self, part: str) -> int:
        return sum(b.rows for b in self.buckets.get(part, {}).values())


@dataclass(frozen=True)
class Change:
    """Rows to put in place of those with their keys, and keys (the part's first column) of rows to remove."""

    rows: DataFrame | None = None
    removed: DataFrame | None = None


def _digest(columns: list[str]) -> Column:
    """128 bits over rows in any order, told apart by all columns, with their number."""
    marks = [F.hex(F.bit_xor(F.xxhash64(F.lit(seed), *sorted(columns)))) for seed in (1, 2)]
    return F.concat_ws("-", F.count("*").cast("string"), *marks)


class BucketStore:
    """Parts of an index below ``root``, in ``n_buckets`` buckets each (fixed by the first commit).

    ``n_buckets`` bounds what the driver reads and a commit names; choose it so
    that a bucket is a task's work at the size that the index will reach.
    """

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 64) -> None:
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), n_buckets
        self.files = Files(spark, root)
        self.leases, self.writers = Marks(self.files, "leases"), Marks(self.files, "writers")

    # entries

    def current(self) -> Entry:
        """The last entry; number 0 and no rows where nothing was committed."""
        names = [x.name for x in self.files.listed("entries")]
        return self._entry(int(names[-1])) if names else Entry(0, self.n_buckets)

    def _entry(self, number: int) -> Entry:
        text = self.files.text(f"entries/{number:010d}")
        if text is None:
            raise LookupError(f"entry {number} is gone")
        return Entry.parse(number, text)

    def read(self, part: str, entry: Entry | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a part at ``entry`` (or the current one); with ``only`` of these buckets alone."""
        entry = entry or self.current()
        found = [b.folder for k, b in sorted(entry.buckets.get(part, {}).items()) if only is None or k in only]
        if part not in entry.schemas:
            raise LookupError(f"no {part} are committed")
        schema = StructType.fromJson(json.loads(entry.schemas[part]))
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in found))

    def bucket(self, part: str, entry: Entry) -> Column:
        return F.pmod(F.xxhash64(F.col(PARTS[part][0]).cast("string")), F.lit(entry.n_buckets)).cast("int")

    # commits

    def commit(self, changes: dict[str, Change], base: Entry, batch: tuple[str, int] | None = None) -> Entry:
        """The entry that follows ``base`` with ``changes`` to its parts; ``base`` itself where nothing changes.

        Rows of a change that repeat a key are refused, and so are bad vectors
        and vectors without a chunk.  ``batch`` names a stream and its batch: one
        that was committed before changes nothing.  Raises ``Conflict`` if
        another writer has taken the next entry.
        """
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base
        folder = f"data/{base.number + 1:010d}-{uuid.uuid4().hex}"
        buckets, schemas, touched = dict(base.buckets), dict(base.schemas), False
        for part, change in changes.items():
            new = self._rewritten(part, change, base, folder)
            if new is not None:
                touched, (buckets[part], schemas[part]) = True, new
        if not touched and not batch:
            return base
        entry = Entry(base.number + 1, base.n_buckets, buckets, schemas, base.batches | ({batch[0]: batch[1]} if batch else {}))
        if "vectors" in changes or "chunks" in changes:
            self._refuse_orphans(entry, base)
        if not self.files.put_once(f"entries/{entry.number:010d}", entry.text()):
            self.files.delete(folder)
            raise Conflict(f"entry {entry.number} was taken by another writer")
        return entry

    def _rewritten(self, part: str, change: Change, base: Entry, folder: str) -> tuple[dict[int, Bucket], str] | None:
        """The part's buckets and schema after ``change``; None where it names no rows."""
        key, rows, place = list(PARTS[part]), change.rows, self.bucket(part, base)
        named = [x.select(key[0], place.alias("bucket")) for x in (rows, change.removed) if x is not None]
        touched = {r.bucket for x in named for r in x.select("bucket").distinct().collect()}  # n_buckets at most
        if not touched:
            return None
        there = {k for k in base.buckets.get(part, {}) if k in touched}
        if part in base.schemas:
            kept = self.read(part, base, there)
            # one join by the first column, so that rows are shuffled once, against hashed keys, so that they are not sorted
            names = [f"__gone_{k}" for k in key]
            removed = [] if change.removed is None else [change.removed.select(F.col(key[0]).alias(names[0]), F.lit(True).alias("__all"))]
            replaced = [] if rows is None else [rows.select(*(F.col(k).alias(n) for k, n in zip(key, names)), F.lit(False).alias("__all"))]
            gone = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), replaced + removed)
            same = F.col(key[0]) == F.col(names[0])
            if len(key) > 1 and replaced:
                same &= F.col("__all") | reduce(Column.__and__, (F.col(k) == F.col(n) for k, n in zip(key[1:], names[1:])))
            kept = kept.join(gone.hint("shuffle_hash"), same, "left_anti")
            new = kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
        elif rows is None:
            return None
        else:
            new = rows
        path = f"{folder}/{part}"
        new.withColumn("bucket", place).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        schema = new.schema.json()
        placed = {int(x.name.partition("=")[2]) for x in self.files.listed(path) if x.is_folder}
        written = {}
        if placed:
            stored = self.spark.read.schema(StructType([*new.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.root}/{path}")
            if part == "vectors":
                refuse_bad_vectors(stored)
            if stored.filter(" or ".join(f"{k} is null" for k in key)).limit(1).count():
                raise ValueError(f"{part} without a key")
            twice = stored.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key).limit(5).collect()
            if twice:
                raise ValueError(f"{part} that repeat a key: {[tuple(r) for r in twice]}")
            found = stored.groupBy("bucket").agg(F.count("*").alias("rows"), _digest(new.columns).alias("digest")).collect()
            written = {r.bucket: Bucket(f"{path}/bucket={r.bucket}", r.rows, r.digest) for r in found}
        rest = {k: b for k, b in base.buckets.get(part, {}).items() if k not in touched}
        return rest | written, schema

    def _refuse_orphans(self, entry: Entry, base: Entry) -> None:
        """Refuse an entry of which a vector has no chunk; buckets that did not change need no look."""
        new = {k for part in ("chunks", "vectors") for k in range(entry.n_buckets) if entry.buckets.get(part, {}).get(k) != base.buckets.get(part, {}).get(k)}
        if "vectors" not in entry.schemas or not new:
            return
        vectors = self.read("vectors", entry, new)
        if "chunks" in entry.schemas:
            vectors = vectors.join(self.read("chunks", entry, new).select("chunk_id"), "chunk_id", "left_anti")
        if vectors.limit(1).count():
            raise ValueError("a vector has no chunk")

    def rewritten(self, part: str, old: Entry, new: Entry) -> int:
        """In how many buckets of a part two entries differ."""
        a, b = old.buckets.get(part, {}), new.buckets.get(part, {})
        return sum(a.get(k) != b.get(k) for k in a.keys() | b.keys())

    def verify(self, entry: Entry | None = None) -> None:
        """Read every bucket and raise ``Damaged`` where rows are not those of the entry."""
        entry = entry or self.current()
        for part in entry.buckets:
            rows = self.read(part, entry)
            found = rows.groupBy(self.bucket(part, entry).alias("bucket")).agg(_digest(rows.columns).alias("digest")).collect()
            want = {k: b.digest for k, b in entry.buckets[part].items()}
            if bad := sorted(k for k, d in ({r.bucket: r.digest for r in found} | {k: None for k in want.keys() - {r.bucket for r in found}}).items() if want.get(k) != d):
                raise Damaged(f"{part}: buckets {bad[:5]} are not those that entry {entry.number} names")

    # readers

    def pin(self, seconds: float = 3600) -> Lease:
        """A lease on the current entry: its rows stay readable until the lease is released or its time is over.

        The entry is looked up again once the lease is there, for a collection
        may have begun before: it kept what was current then.
        """
        while True:
            entry = self.current()
            lease = Lease(self, entry, f"{entry.number:010d}-{uuid.uuid4().hex}")
            lease.renew(seconds)
            if self.current().number == entry.number:
                return lease
            lease.release()

    @contextmanager
    def writing(self, seconds: float = 3600) -> Iterator[None]:
        """Show that a refresh is under way, as ``is_refreshing`` tells, until the block ends or ``seconds`` are over."""
        name = uuid.uuid4().hex
        self.writers.set(name, seconds)
        try:
            yield
        finally:
            self.writers.clear(name)

    def is_refreshing(self) -> bool:
        return bool(self.writers.held())

    # garbage

    def collect_garbage(self, grace_seconds: float = 0, staged_seconds: float = 86_400) -> list[str]:
        """Delete bucket folders that nobody needs, and return their names.

        Needed are those of the current entry, of pinned ones, and of those that
        another one followed less than ``grace_seconds`` ago.  Folders of a commit
        under way have a number past the current one; they are kept
        ``staged_seconds`` from their last change.
        """
        listed = self.files.listed("entries")
        if not listed:
            return []
        current, now = int(listed[-1].name), time.time()
        pinned = {int(name.partition("-")[0]) for name in self.leases.held()}  # behind the look at the current entry
        live = {current} | {n for n in (int(x.name) for x in listed) if n in pinned}
        live |= {int(x.name) for x, after in zip(listed, listed[1:]) if now - after.changed < grace_seconds}
        needed = {b.folder for n in live for x in self._entry(n).buckets.values() for b in x.values()}
        gone = []
        for folder in self.files.listed("data"):
            if int(folder.name.partition("-")[0]) > current:
                if now - folder.changed >= staged_seconds:
                    gone.append(f"data/{folder.name}")
                continue
            parts = [f"data/{folder.name}/{p.name}" for p in self.files.listed(f"data/{folder.name}")]
            inside = [f"{p}/{b.name}" for p in parts for b in self.files.listed(p) if b.is_folder]
            dead = [x for x in inside if x not in needed]
            gone += [f"data/{folder.name}"] if len(dead) == len(inside) else dead
        for name in gone:
            self.files.delete(name)
        for x in listed:
            if int(x.name) not in live:
                self.files.delete(f"entries/{x.name}")
        return gone

    def forget(self) -> bool:
        """Delete everything below ``root``; False if nothing was there."""
        return self.files.delete()


@dataclass
class Lease:
    """A reader's hold on one entry."""

    store: BucketStore
    entry: Entry
    name: str

    def read(self, part: str) -> DataFrame:
        return self.store.read(part, self.entry)

    def renew(self, seconds: float = 3600) -> None:
        self.store.leases.set(self.name, seconds)

    def release(self) -> None:
        self.store.leases.clear(self.name)

    def is_current(self) -> bool:
        return self.store.current().number == self.entry.number

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.release()

