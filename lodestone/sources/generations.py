"""Index generations: immutable Parquet folders, and numbered pointers of which the last names the current one."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import refuse_bad_vectors


class GenerationStore:
    """Chunks and vectors below ``root``; a publish is the creation of one more pointer.

    A pointer's number can be taken once, and no pointer is moved or replaced:
    there is a current generation at every moment from the first publish on, and
    of two writers with one number the second tries the next.  All file work goes through Hadoop's file systems, so ``root`` may be in any
    store that Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def _pointers(self) -> list[tuple[str, str]]:
        """Number and generation of all pointers in order; one that its writer has not filled yet is left out."""
        fs, at = self._fs()
        folder = at(f"{self.root}/pointers")
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
        found = [(n, self._text(fs, at(f"{self.root}/pointers/{n}"))) for n in names if not n.startswith(".")]
        return [(n, text.strip()) for n, text in found if text.endswith("\n")]

    def _text(self, fs, path) -> str:
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def current(self) -> str | None:
        """Name of the current generation."""
        pointers = self._pointers()
        return pointers[-1][1] if pointers else None

    def read(self, part: str) -> DataFrame:
        """``chunks`` or ``vectors`` of the current generation."""
        name = self.current()
        if name is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/generations/{name}/{part}")

    def publish(self, chunks: DataFrame, vectors: DataFrame) -> str:
        """Write a generation and make it current; equal rows are one, and every vector needs its chunk.

        Null, zero, non-finite and empty vectors, vectors of different lengths
        for one model, and different rows of one key are refused before anything
        is published.
        """
        name = uuid.uuid4().hex
        folder = f"{self.root}/generations/{name}"
        chunks.distinct().write.parquet(f"{folder}/chunks")
        vectors.distinct().write.parquet(f"{folder}/vectors")
        stored = self.spark.read.parquet(f"{folder}/vectors")
        refuse_bad_vectors(stored)
        for part, key in (("chunks", ["chunk_id"]), ("vectors", ["chunk_id", "model"])):
            if self.spark.read.parquet(f"{folder}/{part}").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
                raise ValueError(f"{part} of one key differ")
        orphans = stored.join(self.spark.read.parquet(f"{folder}/chunks").select("chunk_id"), "chunk_id", "left_anti")
        if orphans.limit(1).count():
            raise ValueError("a vector has no chunk")
        self._point_to(name)
        return name

    def replace(self, chunks: DataFrame, vectors: DataFrame, removed: DataFrame) -> str:
        """Publish the current generation without ``removed`` (chunk_id), with ``chunks`` and ``vectors`` in place of theirs."""
        if chunks.join(removed, "chunk_id", "left_semi").limit(1).count():
            raise ValueError("a chunk is both written and removed")
        gone = chunks.select("chunk_id").unionByName(removed.select("chunk_id")).distinct()
        kept_chunks = self.read("chunks").join(gone, "chunk_id", "left_anti").unionByName(chunks)
        kept_vectors = self.read("vectors").join(removed, "chunk_id", "left_anti").join(vectors.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").unionByName(vectors)
        return self.publish(kept_chunks, kept_vectors)

    def stats(self) -> dict[str, int]:
        return {part: self.read(part).count() for part in ("chunks", "vectors")}

    def _point_to(self, name: str) -> None:
        fs, at = self._fs()
        folder = at(f"{self.root}/pointers")
        number = 1 + max((int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()), default=0) if fs.exists(folder) else 1
        while True:
            try:
                stream = fs.create(at(f"{self.root}/pointers/{number:010d}"), False)
                break
            except Py4JJavaError as error:
                if "AlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                number += 1
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()

    def check(self) -> None:
        """Refuse a current generation whose ids repeat, or whose vectors lack their chunk."""
        chunks, vectors = self.read("chunks"), self.read("vectors")
        twice = chunks.groupBy("chunk_id").count().filter("count > 1").limit(1).count() + vectors.groupBy("chunk_id", "model").count().filter("count > 1").limit(1).count()
        if twice or vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti").limit(1).count():
            raise ValueError("the generation is damaged: ids repeat, or a vector has no chunk")

    def collect_garbage(self, grace_seconds: float = 0, staged_seconds: float = 86_400) -> list[str]:
        """Delete superseded and abandoned generations; returns their names.

        A superseded generation is kept ``grace_seconds`` from the time another
        one took its place, for those who still read it.  A generation that no
        pointer names may be one that a writer is about to publish: it is kept
        ``staged_seconds`` from its last change.
        """
        fs, at = self._fs()
        folder = at(f"{self.root}/generations")
        if not fs.exists(folder):
            return []
        found = [(x.getPath().getName(), x.getModificationTime() / 1000) for x in fs.listStatus(folder)]
        pointers, now = self._pointers(), time.time()
        current = pointers[-1][1] if pointers else None
        ended = {}
        for (_, name), (number, _) in zip(pointers, pointers[1:]):
            ended[name] = fs.getFileStatus(at(f"{self.root}/pointers/{number}")).getModificationTime() / 1000
        old = [n for n, changed in found if n != current and (now - ended[n] >= grace_seconds if n in ended else now - changed >= staged_seconds)]
        for name in old:
            fs.delete(at(f"{self.root}/generations/{name}"), True)
        return old

    def forget(self) -> bool:
        """Delete everything below ``root``; False if nothing was there."""
        fs, at = self._fs()
        there = fs.exists(at(self.root))
        return bool(there and fs.delete(at(self.root), True))


def prune(spark: SparkSession, root: str, wanted: set[str], unused_seconds: float = 30 * 86_400) -> list[str]:
    """Forget the stores below ``root`` that are not ``wanted`` (folder names) and were not published to for so long; returns their names.

    Stores of collections that are gone and of other configurations are told by
    the names that the caller no longer wants.
    """
    make = spark._jvm.org.apache.hadoop.fs.Path
    folder = make(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        pointers = make(f"{root.rstrip('/')}/{name}/pointers")
        last = max((x.getModificationTime() for x in fs.listStatus(pointers)), default=0) if fs.exists(pointers) else status.getModificationTime()
        if name not in wanted and time.time() - last / 1000 >= unused_seconds and GenerationStore(spark, f"{root.rstrip('/')}/{name}").forget():
            gone.append(name)
    return sorted(gone)
