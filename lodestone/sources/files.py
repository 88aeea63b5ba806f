"""Small files in any store that Hadoop's file systems reach: entries that can be taken once, marks with an end."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Found:
    """Name, time of the last change (seconds) and kind of what stands in a folder."""

    name: str
    changed: float
    is_folder: bool


class Files:
    """Files below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self.at(name)))

    def listed(self, folder: str) -> list[Found]:
        """What stands in ``folder``, by name; hidden names are left out, a folder that isn't there is empty."""
        try:
            found = self._fs.listStatus(self.at(folder))
        except Py4JJavaError as error:
            if "FileNotFound" in error.java_exception.getClass().getName():
                return []
            raise
        rows = [Found(x.getPath().getName(), x.getModificationTime() / 1000, bool(x.isDirectory())) for x in found]
        return sorted((x for x in rows if not x.name.startswith((".", "_"))), key=lambda x: x.name)

    def text(self, name: str) -> str | None:
        """The text of a file, None where there is none."""
        try:
            stream = self._fs.open(self.at(name))
        except Py4JJavaError as error:
            if "FileNotFound" in error.java_exception.getClass().getName():
                return None
            raise
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a whole file and put it in place by a rename, over one that is there."""
        draft = self._drafted(name, text)
        self._renamed(draft, name, "OVERWRITE")

    def put_once(self, name: str, text: str) -> bool:
        """Write a file unless there is one; False if another writer has taken the name.

        The text is written beside its place and renamed without overwriting, so
        that a name is there with its whole text or not at all, whatever happens
        to the writer.  It is read back, for stores that check and rename in two
        steps: of two writers the one whose text stands there has won.
        """
        if self.exists(name):
            return False
        draft = self._drafted(name, text)
        if not self._renamed(draft, name, "NONE"):
            self.delete(draft)
            return False
        return self.text(name) == text

    def _drafted(self, name: str, text: str) -> str:
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}"
        stream = self._fs.create(self.at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        return draft

    def _renamed(self, source: str, target: str, how: str) -> bool:
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = getattr(rename, how)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self._conf)
        try:
            context.rename(self.at(source), self.at(target), options)
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    def delete(self, name: str = "") -> bool:
        return bool(self.exists(name) and self._fs.delete(self.at(name), True))


class Marks:
    """Files in a folder, each of which says until when it holds; one whose end is past counts no more."""

    def __init__(self, files: Files, folder: str) -> None:
        self.files, self.folder = files, folder

    def set(self, name: str, seconds: float) -> None:
        self.files.write(f"{self.folder}/{name}", f"{time.time() + seconds:.3f}")

    def clear(self, name: str) -> None:
        self.files.delete(f"{self.folder}/{name}")

    def held(self) -> list[str]:
        """Names of the marks that hold; past ones are deleted."""
        out = []
        for found in self.files.listed(self.folder):
            until = self.files.text(f"{self.folder}/{found.name}")
            if until is not None and float(until) > time.time():
                out.append(found.name)
            elif until is not None:
                self.clear(found.name)
        return out
