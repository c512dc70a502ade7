"""A versioned dataset: entries as a base and deltas, a key log per version, and the control
record that says which files count.

Writers read the record, write their files and put the next record by compare and swap. One that
lost starts again from the record that won, so nothing that another has committed is lost.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.decode import decode
from morphlake.operators.log import newest, numbered, staged
from morphlake.plans.compile import Step, compile_step
from morphlake.plans.diff import Diff
from morphlake.plans.model import Shape
from morphlake.sources.control import Control, MigrationError, run_of
from morphlake.sources.files import KEPT, Folder, Record, alone

LOG_SCHEMA = "pos bigint, key string"
#: Folders below a store that hold data.
KINDS = ("entries", "log", "staged", "visits", "forks")
#: How often a writer that lost starts again.
ATTEMPTS = 50
#: Keys up to which a set of them is broadcast, to read only their entries.
BROADCAST_KEYS = 100_000


class Conflict(Exception):
    """Another writer has put the next record."""


def retried(f: Callable) -> Callable:
    """Runs a read-change-commit again from the newest record until its commit is taken."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        for _ in range(ATTEMPTS):
            try:
                return f(*args, **kwargs)
            except Conflict as e:
                lost = e
        raise lost

    return run


class Store:
    """Entries have a `key` (string) and one column per field. Later rows of a key win.

    sole: one process alone writes the store, and reads no states but the newest, the one before it and pinned ones.
    Each commit then deletes what these don't name, so what is on disk does not grow with the steps.
    """

    def __init__(self, spark: SparkSession, root: str | Path, sole: bool = False):
        self.spark, self.folder, self.sole = spark, Folder(root, spark), sole
        self.root = self.folder.root
        self.record = Record(self.folder, "state", 0 if sole else KEPT)

    def control(self, number: int | None = None) -> Control:
        """The newest state, or the one of a record that is kept or pinned."""
        return Control.load(self.record, number)

    def commit(self, control: Control) -> None:
        if not control.save(self.record):
            raise Conflict(f"record {control.commits + 1} is taken")
        if self.sole:
            self.sweep(-1)

    def write(self, df: DataFrame, kind: str) -> str:
        """A new folder with df; nobody sees it before a commit names it."""
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        with alone(self.spark):
            df.write.parquet(path)
        return path

    def append(self, df: DataFrame, path: str) -> None:
        """More rows for a folder that no commit has named yet."""
        with alone(self.spark):
            df.write.mode("append").parquet(path)

    def discard(self, path: str) -> None:
        """Deletes a folder that no commit has named."""
        self.folder.delete(path.removeprefix(f"{self.root}/"))

    # -------- version marker

    @retried
    def initialize(self, version: int) -> None:
        c = self.control()
        if version < 1:
            raise MigrationError("InvalidVersion", str(version))
        if c.version == version:
            return
        if c.version is not None:
            raise MigrationError("VersionMismatch", f"recorded {c.version}")
        c.version = version
        self.commit(c)

    @retried
    def adopt(self, version: int) -> None:
        c = self.control()
        if version < 1:
            raise MigrationError("InvalidVersion", str(version))
        if c.migration and c.migration.active:
            raise MigrationError("MigrationAlreadyActive")
        c.version = version
        self.commit(c)

    # -------- entries

    def _merged(self, c: Control, folders: list[str], keys: DataFrame | None = None, exact: bool = True) -> DataFrame:
        """The newest row of each key over some folders of entries, oldest first. Removals are rows too."""
        rows = self.spark.read.schema(", ".join(f"`{k}` {v}" for k, v in c.schema.items())).parquet(*folders)
        merged = len(folders) > 1
        if merged:
            rows = rows.withColumn("__folder", F.regexp_extract("_metadata.file_path", "/entries/([0-9a-f]+)/", 1))
        if keys is not None:
            low, high, n = keys.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
            rows = rows.filter(F.col("key").between(low, high))
            if exact or n <= BROADCAST_KEYS:
                rows = rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, "key", "left_semi")
        if not merged:
            return rows
        order = self.spark.createDataFrame([(p.rsplit("/", 1)[1], i) for i, p in enumerate(folders)], "__folder string, __commit int")
        rows = rows.join(F.broadcast(order), "__folder").drop("__folder")  # a row a commit
        return newest(rows, ["key"], ["__commit"]).drop("__commit")

    def roll(self, c: Control) -> None:
        """Merges runs of folders of about one size at the end of the record's lists, so that the lists, and what a
        reader opens, grow with the logarithm of the writes. The folders that are replaced stay for readers of
        older states, until they are swept."""
        while (first := run_of([c.sizes.get(x) for x in c.entries])) is not None:
            path = self.write(self._merged(c, c.entries[first:]).sort("key"), "entries")
            c.replace(c.entries, first, path, self.spark.read.parquet(path).count())
        for folders in c.logs.values():
            while (first := run_of([c.sizes.get(x) for x in folders])) is not None:
                n = sum(c.sizes[x] for x in folders[first:])
                c.replace(folders, first, self.write(self.spark.read.schema(LOG_SCHEMA).parquet(*folders[first:]), "log"), n)

    def segments(self, version: int, control: Control | None = None) -> DataFrame:
        """segment, length, first_pos, last_pos: the pieces in which a version's log is stored, in order."""
        c = control or self.control()
        rows, start = [], 0
        for i, path in enumerate(c.log(version)):
            n = c.sizes[path] if path in c.sizes else self.spark.read.parquet(path).count()
            rows.append((i, n, start, start + n - 1))
            start += n
        return self.spark.createDataFrame(rows, "segment int, length bigint, first_pos bigint, last_pos bigint")

    def footprint(self, version: int) -> int:
        """What a reader of a version's log opens: its pieces and the record."""
        found = len(self.control().log(version))
        return found + 1 if found else 0

    def sweep(self, age: float = 7 * 24 * 3600.0) -> list[str]:
        """Deletes folders that no kept or pinned state names and whose newest file is older than age (in seconds;
        longer than any writer takes, since what a writer has not committed yet is named by nobody). Readers of kept and
        pinned states go on. Returns what was deleted."""
        before = time.time() - age
        old = [f"{kind}/{name}" for kind in KINDS for name, at in self.folder.newest(kind).items() if at < before]
        forks = [Record(Folder(f"{self.root}/forks/{name}", self.spark), "state") for name in self.folder.newest("forks")]
        named = {"/".join(x.rsplit("/", 2)[-2:]) for r in (self.record, *forks) for n in {*r.kept(), *r.pins()} for x in self._named(r, n)}
        gone = [x for x in old if x not in named]
        for x in gone:
            self.folder.delete(x)
        return gone

    @staticmethod
    def _named(record: Record, number: int) -> set[str]:
        try:
            return Control.load(record, number).folders()
        except KeyError:  # no longer kept
            return set()

    def entries(self, control: Control | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The current rows: newest commit of each key, without removed ones.

        With keys (distinct), only theirs. Entries are written in order of their keys, so the range
        of the keys prunes files and row groups before anything is merged.
        """
        c = control or self.control()
        if not c.entries:
            return self.spark.createDataFrame([], "key string")
        return self._live(self._merged(c, c.entries, keys))

    def around(self, c: Control, keys: DataFrame) -> DataFrame:
        """The current rows of at least these keys, for a join to them that follows: of a few keys only theirs, of many
        those in their range, so that many keys are not dealt once more."""
        return self._live(self._merged(c, c.entries, keys, exact=False)) if c.entries else self.entries(c)

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        return rows.filter("coalesce(__removed, false) = false").drop("__removed") if "__removed" in rows.columns else rows

    def compile(self, d: Diff) -> Step:
        """A step over the columns in which this store keeps the shape's fields."""
        a, b = d.from_shape.version, d.to_shape.version
        return compile_step(d, self.control().layout(d.to_shape.name, a, b))

    def read(self, shape: Shape, control: Control | None = None, mode: str = "strict", keys: DataFrame | None = None) -> DataFrame:
        """key and the fields of a version of a shape by their names, from the columns in which they stand.

        What a row lacks is null, and refused (strict) or marked (skip) if the field is required. Rows that a running
        migration has not reached show nothing in the fields that it moves.
        """
        c = control or self.control()
        rows, where = self.entries(c, keys), c.where(shape.name, shape.version)
        there = [(f.name, where.get(f.name, f.name)) for f in shape.fields]
        return decode(rows.select("key", *(F.col(f"`{c}`").alias(f) for f, c in there if c in rows.columns)), shape, mode, ("key",))

    def log(self, version: int, control: Control | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
        """pos and key of a version's log; only the pieces that hold positions from start on, up to limit of them, are read."""
        c = control or self.control()
        paths, at = [], 0
        for path in c.log(version):
            n = c.sizes.get(path)
            if n is None:  # a record from before pieces were counted
                paths, at = c.log(version), 0
                break
            if at + n > start and (limit is None or at < start + limit):
                paths.append(path)
            at += n
        return self.spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)

    def put(self, rows: DataFrame, register: bool = True, stream: tuple[str, int] | None = None, shape: Shape | None = None) -> bool:
        """Writes rows and registers their keys under the version that writes belong to, in one commit.

        shape: rows have the fields of this shape, which go to the columns in which the store keeps them; without it,
        rows have the store's columns. stream: the name of a stream and the number of its batch, kept in the same commit; a batch
        that the record has is left out. Says whether the rows were put.
        """
        if stream and self.control().streams.get(stream[0], -1) >= stream[1]:
            return False
        if shape:
            where = self.control().where(shape.name, shape.version)
            rows = rows.select("key", *(F.col(f"`{f}`").alias(where.get(f, f)) for f in shape.names if f in rows.columns))
        path = self.write(rows.sort("key"), "entries")
        written = self.spark.read.parquet(path)
        staged = self._staged(written) if register else None
        done = self._put(path, written, staged, stream, sum(n for _, n in staged[1]) if staged else written.count())
        self._unstage(staged)
        return done

    @retried
    def _put(self, path: str, written: DataFrame, staged: tuple | None, stream: tuple[str, int] | None, n: int) -> bool:
        c = self.control()
        if stream:
            if c.streams.get(stream[0], -1) >= stream[1]:
                return False
            c.streams[stream[0]] = stream[1]
        c.add_entries(path, written, n)
        if staged:
            self._register(c, c.write_version, staged)
        self.roll(c)
        self.commit(c)
        return True

    @retried
    def update(self, shape: Shape, keys: DataFrame, change: Callable[[DataFrame], DataFrame], step: Step | None = None) -> int:
        """Reads the rows of some keys by a shape, changes and writes them, in one commit; returns how many keys were written.

        change gets key and the shape's fields (null for keys without an entry) and returns rows of the same columns;
        those it leaves out are not written. shape is that of the version that writes belong to: while a migration
        runs, the new one, and with its step rows that have not been reached are seen, and written, as it moves them; their
        later visit finds them current. If another writer commits meanwhile, all is done again on what that writer left, so
        no change is lost.
        """
        c = self.control()
        if c.write_version != shape.version:
            raise MigrationError("VersionMismatch", f"writes belong to v{c.write_version}, not v{shape.version}")
        keys, where = keys.select("key").distinct(), c.where(shape.name, shape.version)
        found = keys.join(self.entries(c, keys), "key", "left")
        if step:
            found = step.up(found).drop("outcome")
        there = [(f.name, where.get(f.name, f.name)) for f in shape.fields]
        seen = decode(found.select("key", *(F.col(f"`{x}`").alias(f) for f, x in there if x in found.columns)), shape, "skip", ("key",)).drop("_decode_ok")
        made = decode(change(seen), shape, "strict", ("key",))  # a row without a required field is refused
        path = self.write(made.select("key", *(F.col(f"`{f}`").alias(x) for f, x in there)).sort("key"), "entries")
        written = self.spark.read.parquet(path)
        staged = self._staged(written)
        n = sum(n for _, n in staged[1])
        c.add_entries(path, written, n)
        self._register(c, c.write_version, staged)
        self.roll(c)
        self._unstage(staged)
        self.commit(c)
        return n

    def put_unindexed(self, rows: DataFrame) -> None:
        self.put(rows, register=False)

    def register(self, version: int, keys: DataFrame) -> None:
        """Appends keys to a version's log, in the order of their text."""
        staged = self._staged(keys)

        @retried
        def add() -> None:
            c = self.control()
            self._register(c, version, staged)
            self.commit(c)

        add()
        self._unstage(staged)

    def _staged(self, keys: DataFrame) -> tuple[str, list[tuple[int, int]]]:
        """Keys sorted once and written, with the rows of each part of the order."""
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        return path, staged(keys.select("key"), ["key"], path)

    def _unstage(self, staged: tuple | None) -> None:
        if staged:
            self.discard(staged[0])

    def _register(self, c: Control, version: int, keys: tuple[str, list[tuple[int, int]]]) -> None:
        """Numbers staged keys on from the log's end, part by part from the parts' counts."""
        path, counts = keys
        if counts:
            rows = numbered(self.spark, path, counts, c.length(version))
            c.add_log(version, self.write(rows.select("pos", "key"), "log"), sum(n for _, n in counts))

    def remove(self, keys: DataFrame) -> None:
        """Deletes entries; the log keeps their keys, and a later visit skips them."""
        path = self.write(keys.select("key", F.lit(True).alias("__removed")).sort("key"), "entries")
        written = self.spark.read.parquet(path)
        self._put(path, written, None, None, written.count())

    @retried
    def reset_log(self, version: int, control: Control | None = None) -> None:
        """A log that is truly empty: its old files are no longer named."""
        c = control or self.control()
        c.unsized(c.logs.pop(str(version), []))
        c.lengths.pop(str(version), None)
        if control is None:
            self.commit(c)

    @retried
    def compact(self) -> None:
        """Writes the current rows as one base."""
        c = self.control()
        if len(c.entries) > 1:
            rows = self.entries(c)
            path = self.write(rows.sort("key"), "entries")
            for x in c.entries:
                c.sizes.pop(x, None)
            c.entries, c.schema = [], {}
            c.add_entries(path, rows, self.spark.read.parquet(path).count())
            self.commit(c)
