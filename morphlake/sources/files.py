"""Small text files in a file system that all machines share, and records kept as numbered files.

A path with file: is local, as is one without a scheme where Spark's default is. Any other goes through Spark's file systems, so
a store may lie wherever the cluster can read. A record is a series of numbered files of which the
newest counts; a new one is made only if no other has its number, so of two writers that started
from one number, one is told that it lost.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

#: Old files of a record that are kept for readers that are under way.
KEPT = 100


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines see: below spark.checkpoint.dir, or a temporary one where all
    runs in one process. On a cluster that names none, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: a folder that all machines share is needed")
    return tempfile.mkdtemp(prefix="morphlake-store")


@contextmanager
def alone(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned in here go as soon as it ends: else they stay until the driver happens
    to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Folder:
    def __init__(self, root: str | Path, spark: SparkSession | None = None):
        text = str(root)
        self.root = (text.removeprefix("file://") if text.startswith("file://") else text.removeprefix("file:")).rstrip("/") or "/"
        self.local = "://" not in self.root
        self.spark = spark
        if self.local and spark is not None and not text.startswith("file:"):  # as Spark's own readers and writers take it
            self.local = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
        if not self.local and spark is None:
            raise ValueError(f"{root}: a session is needed for this file system")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, stem: str) -> list[str]:
        if self.local:
            found = os.listdir(self.root) if os.path.isdir(self.root) else []
        else:
            store, path = self._at("")
            found = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
        return sorted(x for x in found if x.startswith(stem))

    def read(self, name: str) -> str | None:
        if self.local:
            path = Path(self.root, name)
            return path.read_text() if path.exists() else None
        store, path = self._at(name)
        if not store.exists(path):
            return None
        stream = store.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a whole file, and says whether it did: one of that name is never replaced.

        Locally by a link, elsewhere by a rename, which file systems like HDFS refuse if the name is
        taken; an object store needs one with conditional puts.
        """
        hidden = f"_{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            own = Path(self.root, hidden)
            own.write_text(text)
            try:
                os.link(own, Path(self.root, name))
            except FileExistsError:
                return False
            finally:
                own.unlink()
            return True
        (store, path), (_, own) = self._at(name), self._at(hidden)
        if store.exists(path):
            return False
        stream = store.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        made = store.rename(own, path)
        if not made:
            store.delete(own, False)
        return bool(made)

    def delete(self, name: str) -> None:
        """A file or a whole folder."""
        if self.local:
            path = Path(self.root, name)
            shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
        else:
            store, path = self._at(name)
            store.delete(path, True)

    def newest(self, name: str) -> dict[str, float]:
        """The folders below a folder, each with the time (in seconds) of its newest file."""
        if self.local:
            found = [x for x in os.scandir(Path(self.root, name)) if x.is_dir()] if os.path.isdir(Path(self.root, name)) else []
            return {x.name: max([os.stat(x).st_mtime, *(y.stat().st_mtime for y in os.scandir(x))]) for x in found}
        store, path = self._at(name)
        found = [x.getPath() for x in store.listStatus(path) if x.isDirectory()] if store.exists(path) else []
        return {x.getName(): max([0, *(y.getModificationTime() for y in store.listStatus(x))]) / 1000 for x in found}

    def size(self) -> int:
        """Bytes of all files below."""
        if self.local:
            return sum(p.stat().st_size for p in Path(self.root).rglob("*.parquet"))
        store, path = self._at("")
        return store.getContentSummary(path).getLength() if store.exists(path) else 0


class Record:
    """A text with a number; the next one is made by compare and swap. So many as keep says stay before the last two."""

    def __init__(self, folder: Folder, stem: str, keep: int = KEPT):
        self.folder, self.stem, self.keep = folder, stem, keep

    def _name(self, number: int) -> str:
        return f"{self.stem}.{number:012d}.json"

    def newest(self) -> tuple[int, str | None]:
        while True:
            names = self.folder.names(f"{self.stem}.")
            if not names:
                return 0, None
            text = self.folder.read(names[-1])
            if text is not None:  # else it was old by the time it was opened
                return int(names[-1].split(".")[-2]), text

    def read_text(self) -> str | None:
        return self.newest()[1]

    def at(self, number: int) -> str:
        """The text of a number that is kept or pinned."""
        text = self.folder.read(self._name(number))
        if text is None and (text := self.folder.read(self._pinned(number))) is None:
            raise KeyError(f"{self.stem} {number} is not kept")
        return text

    def _pinned(self, number: int) -> str:
        return f"pinned-{self._name(number)}"

    def pin(self, number: int) -> None:
        """Keeps a number for good, however many follow it."""
        self.folder.create(self._pinned(number), self.at(number))

    def kept(self) -> list[int]:
        return [int(x.split(".")[-2]) for x in self.folder.names(f"{self.stem}.")]

    def pins(self) -> list[int]:
        return [int(x.split(".")[-2]) for x in self.folder.names(f"pinned-{self.stem}.")]

    def unpin(self, number: int) -> None:
        self.folder.delete(self._pinned(number))

    def put(self, base: int, text: str) -> bool:
        """Makes number base + 1, if base is still the newest."""
        if not self.folder.create(self._name(base + 1), text):
            return False
        names = self.folder.names(f"{self.stem}.")
        if base and self._name(base) not in names:  # so old that it and its followers have been deleted
            self.folder.delete(self._name(base + 1))
            return False
        for name in names:  # oldest first
            if name < self._name(max(base - self.keep, 0)):
                self.folder.delete(name)
        return True
