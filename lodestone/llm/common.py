"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of the tables that this driver wrote.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset and Spark runs
    in this process alone, as in tests, a temporary folder of this machine takes
    its place; on a cluster that would lose what executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of executors without
    running the steps before it again.  Results read such tables; once they are
    stored, ``remove_written`` clears the tables away.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that ``materialise`` wrote in this driver, and return their number.  Results not stored yet are lost."""
    n = len(_written)
    while _written:
        delete_path(spark, _written.pop())
    return n


class Scratch:
    """Writes tables as ``materialise`` does, into one folder that ``clear`` removes."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.folder = spark, new_path(spark, label)

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.folder}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        delete_path(self.spark, self.folder)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and leave every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def text_chunks(batch: pa.RecordBatch, limit: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts (UTF-8, null as empty) of a batch, in runs of about ``limit`` bytes."""
    ids, texts, size = [], [], 0
    names = batch.schema.names
    for doc_id, text in zip(batch.column(names.index("doc_id")), batch.column(names.index("text")).cast(pa.binary())):
        raw = text.as_py() or b""
        ids.append(doc_id.as_py())
        texts.append(raw)
        size += len(raw)
        if size > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def worker_state(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a Python worker and kept for its later tasks.

    For models that take long to load and caches that only save work; results
    must not depend on what is in them.
    """
    holder = sys.modules.setdefault("_lodestone_worker_state", types.ModuleType("_lodestone_worker_state"))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]


def release_worker_state() -> None:
    """Drop what earlier tasks left in this Python worker."""
    holder = sys.modules.pop("_lodestone_worker_state", None)
    if holder is not None:
        holder.__dict__.clear()
        trim_memory()


def trim_memory() -> None:
    """Give free memory of this Python worker back to the system; an idle worker keeps its process."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python workers at most ``rows`` rows at once, for what runs inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
