"""The batched rewrite: begin, batch, abort, clear; and rollback, newest first.

One Spark job visits a slice of the log, of one batch or of several: its keys are joined to their entries, the
step's columns are evaluated once and written with their outcomes (a large slice by ranges of its keys, one after
another, so that what is on disk besides the entries does not grow with it), and only then does one
new control record make the batch, the cursor and the carried-forward log visible. A batch that
fails leaves no trace; running it again is harmless, as steps are idempotent. If another writer
commits during a batch, the batch is run again on what that writer left. Keys registered meanwhile
are absorbed going forward and refused going back.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.numbers import DEFAULT_BATCH, LARGEST_BATCH
from morphlake.operators.log import key_ranges, orphans, per_visit, reversed_slice, slice_of, tallies, tally
from morphlake.plans.compile import FunctionStep, Step, VariantStep
from morphlake.plans.model import KeySpace, ShapeError
from morphlake.sources.control import COMPLETED, ROLLED_BACK, ROLLING_BACK, RUNNING, Control, Migration, MigrationError
from morphlake.sources.store import Store, retried


@dataclass(frozen=True)
class Outcome:
    from_version: int
    to_version: int
    cursor: int
    total: int
    visited: int = 0
    migrated: int = 0
    already_current: int = 0
    skipped: int = 0
    done: bool = False

    @property
    def made_progress(self) -> bool:
        return self.visited > 0 or self.done

    @property
    def is_stall(self) -> bool:
        return self.visited == 0 and not self.done


#: Positions that one job visits, about; their rows are on disk twice or three times until they are in order.
AT_ONCE = 1 << 24

#: The counts of a batch that visits nothing.
NOTHING = {"visited": 0, "migrated": 0, "already_current": 0, "skipped": 0}


class DeadlineExpired(Exception):
    """A batch took too long and is known not to be kept."""


def report(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """Outcomes as a table, one row a batch."""
    rows = [(i, *astuple(o)) for i, o in enumerate(outcomes)]
    return spark.createDataFrame(rows, "batch int, from_version int, to_version int, cursor bigint, total bigint, visited bigint, migrated bigint, already_current bigint, skipped bigint, done boolean")


class Executor:
    """Runs one step over a store. strict holds batches to LARGEST_BATCH keys, else any size goes.

    Entries of other shapes are skipped: shape_col names a column that tells them apart, or variant (a key space and
    a variant of it) says whose keys are this shape's; then the entries of other keys are not read at all.
    """

    def __init__(self, store: Store, step: Step | FunctionStep | VariantStep, strict: bool = True, shape_col: str | None = None, variant: tuple[KeySpace, str] | None = None):
        self.store, self.step, self.strict, self.shape_col, self.variant = store, step, strict, shape_col, variant
        self.a, self.b = step.from_version, step.to_version

    def _sized(self, limit: int) -> None:
        if limit == 0:
            raise MigrationError("BatchSizeZero")
        if self.strict and limit > LARGEST_BATCH:
            raise MigrationError("BatchTooLarge", f"{limit} > {LARGEST_BATCH}")

    @retried
    def begin(self) -> Migration:
        c = self.store.control()
        if self.b != self.a + 1:
            raise MigrationError("NotSequential", f"{self.a} -> {self.b}")
        c.require(self.a)
        m = c.migration
        if m and m.is_for(self.a, self.b):
            if m.status == COMPLETED:
                raise MigrationError("AlreadyCompleted")
            if m.status == RUNNING:
                return m
            raise MigrationError("MigrationAlreadyActive", m.status)
        if m and m.active:
            raise MigrationError("WrongMigration", f"{m.from_version} -> {m.to_version} is active")
        self._fits(c)
        self._place(c)
        c.migration = Migration(self.a, self.b, 0, c.length(self.a), RUNNING, c.commits + 1)
        self.store.commit(c)
        return c.migration

    def _fits(self, c: Control) -> None:
        """Refuses a step that was compiled for other columns than those that hold the fields: it would find
        nothing in them and lose the values."""
        where, source = c.where(self.step.name, self.a), getattr(self.step, "source", {})
        if moved := sorted(f for f, column in source.items() if where.get(f, f) != column):
            raise ShapeError(f"{self.step.name} v{self.a}: {', '.join(f'{f} stands in {where.get(f, f)}, not {source[f]}' for f in moved)}; compile the step with the store")
        if c.schema and (unknown := [x for x in self.step.consumed if x not in c.schema]):
            raise ShapeError(f"{self.step.name} v{self.a} -> v{self.b}: the store has no column {', '.join(unknown)} to take values from")

    def _place(self, c: Control) -> None:
        """Records where the fields of both versions stand."""
        name, where = self.step.name, dict(c.where(self.step.name, self.a))
        source = getattr(self.step, "source", None) or where
        if not c.columns.get(name):
            c.placed(name, self.a, source)
        c.placed(name, self.b, self.step.physical if hasattr(self.step, "source") else {**source, **self.step.physical})

    def _state(self, c: Control) -> Migration:
        m = c.migration
        if m is None:
            raise MigrationError("NoActiveMigration")
        if not m.is_for(self.a, self.b):
            raise MigrationError("WrongMigration", f"{m.from_version} -> {m.to_version} is recorded")
        return m

    def _visit(self, c: Control, visits: DataFrame, down: bool, place: Column, limit: int, n: int) -> tuple[str | None, list[dict]]:
        """Evaluates a slice of n positions once; returns the folder of the rows that changed, in order of their keys, and the
        outcomes of its batches. place counts the slice's positions in the order of the visits. Visits of a range of keys
        are deleted when the next one's are written; the last ones stay until they are swept."""
        path, seen, counts = None, None, {}
        for one in key_ranges(visits, n, AT_ONCE):
            if seen:
                self.store.discard(seen)
            seen, found = self._range(c, visits.filter(one), down, place, limit, n)
            for i, x in found.items():
                counts[i] = {k: x[k] + counts.get(i, NOTHING)[k] for k in NOTHING}
            if any(x["migrated"] for x in found.values()):
                rows = self.store.spark.read.parquet(seen).filter("outcome = 'Migrated'").drop("pos", "step", "outcome").sort("key")  # the first visit of each key
                if path:
                    self.store.append(rows, path)
                else:
                    path = self.store.write(rows, "entries")
        got = [counts.get(i, NOTHING) for i in range(-(-n // limit))]
        for i, x in enumerate(got):
            if x["visited"] != (wanted := min(limit, n - i * limit)):
                raise MigrationError("CorruptIndex", f"{x['visited']} of {wanted} positions of batch {i} of the slice")
        return path, got

    def _range(self, c: Control, visits: DataFrame, down: bool, place: Column, limit: int, n: int) -> tuple[str, dict[int, dict]]:
        """The visits of some of a slice's keys, all of each: the folder of their rows, and their counts in each batch. Only
        entries in the range of the keys are read and merged."""
        keys = visits.select("key")
        entries = self.store.around(c, keys.filter(self.variant[0].within(self.variant[1])) if self.variant else keys)
        apart = {x: f"__{x}" for x in ("pos", "step") if x in visits.columns}
        found = visits.withColumnsRenamed(apart).join(entries.withColumn("_present", F.lit(True)), "key", "left").withColumn("_present", F.coalesce("_present", F.lit(False)))
        moved = (self.step.down if down else self.step.up)(found, self.shape_col).drop("_present").withColumnsRenamed({y: x for x, y in apart.items()})
        seen, counted = per_visit(moved, newest_first=down), Observation()
        path = self.store.write(seen.observe(counted, *tallies()), "visits")
        if n <= limit:
            return path, {0: counted.get}
        rows = tally(self.store.spark.read.parquet(path), [F.floor(place / limit).cast("bigint").alias("batch")]).collect()
        return path, {r["batch"]: {k: r[k] for k in NOTHING} for r in rows}

    def _outcomes(self, m: Migration, start: int, limit: int, counts: list[dict]) -> list[Outcome]:
        """The outcomes of batches from start on, up to the cursor of m."""
        ends = [min(start + (i + 1) * limit, m.cursor) for i in range(len(counts))]
        return [Outcome(self.a, self.b, end, m.total, **x, done=end >= m.total) for end, x in zip(ends, counts)]

    def batch(self, limit: int = DEFAULT_BATCH) -> Outcome:
        return self.batches(limit)[0]

    @retried
    def batches(self, limit: int = DEFAULT_BATCH, most: int = 1) -> list[Outcome]:
        """The next batches, at most so many of at most limit keys each, evaluated by one job and made visible by one
        commit: all or none. Each has its own outcome, as if they had run one after another: what an earlier one has
        moved is current for a later one."""
        self._sized(limit)
        c = self.store.control()
        m = self._state(c)
        if m.status == COMPLETED:
            return [Outcome(self.a, self.b, m.cursor, m.total, done=True)]
        if m.status != RUNNING:
            raise MigrationError("NoActiveMigration", m.status)
        start, total = m.cursor, max(m.total, c.length(self.a))
        n, counts = min(limit * most, max(total - start, 0)), [NOTHING]
        if n:
            visits = slice_of(self.store.log(self.a, c, start, n), start, n)
            path, counts = self._visit(c, visits, False, F.col("pos") - start, limit, n)
            self._keep(c, path, counts)
            self._carry(c, self.a, self.b, visits.withColumn("pos", (F.col("pos") - start + c.length(self.b)).cast("bigint")), n)
        m.cursor, m.total = start + n, total
        if m.cursor >= m.total:
            m.status, c.version = COMPLETED, self.b
        self.store.roll(c)
        self.store.commit(c)
        return self._outcomes(m, start, limit, counts)

    def _keep(self, c: Control, path: str | None, counts: list[dict]) -> None:
        """Rows that changed become a delta; rows that did not are not written again. A delta of as many keys as the one
        folder before it has rows holds each of them, and takes its place."""
        if path:
            n = sum(x["migrated"] for x in counts)
            whole = len(c.entries) == 1 and c.sizes.get(c.entries[0]) == n
            c.add_entries(path, self.store.spark.read.parquet(path), n)
            if whole:
                c.replace(c.entries, 0, c.entries[-1], n)

    def _carry(self, c: Control, a: int, b: int, visits: DataFrame, n: int) -> None:
        """The log of b goes on with the n visits of a's. A whole log that starts b's is shared, not written again."""
        if n == c.length(a) and not c.length(b):
            c.share_log(a, b)
        else:
            c.add_log(b, self.store.write(visits.select("pos", "key"), "log"), n)

    def batch_within(self, limit: int, seconds: float) -> Outcome:
        """A batch whose jobs are cancelled after so many seconds (0: never). The record then tells whether
        it was kept: if the cursor has moved, this is what it says; else DeadlineExpired."""
        if not seconds:
            return self.batch(limit)
        before = self._state(self.store.control())
        try:
            return _within(self.store.spark, seconds, lambda: self.batch(limit))
        except DeadlineExpired:
            now = self._state(self.store.control())
            if (now.cursor, now.status) == (before.cursor, before.status):
                raise
            return Outcome(self.a, self.b, now.cursor, now.total, visited=now.cursor - before.cursor, done=now.status == COMPLETED)

    def run_to_completion(self, limit: int = DEFAULT_BATCH, most: int = 1000, together: int = 1) -> list[Outcome]:
        """Batches until done; reaching most is no error, the next call goes on. So many as together says are evaluated by
        one job and kept by one commit, so that the number of jobs does not grow with that of small batches."""
        return _run(self.batches, limit, most, together)

    def status(self) -> Migration | None:
        return self.store.control().migration

    @retried
    def abort(self) -> None:
        """Drops an active migration's record and keeps the work done."""
        c = self.store.control()
        if not (c.migration and c.migration.active):
            raise MigrationError("NoActiveMigration")
        c.migration = None
        self.store.commit(c)

    @retried
    def clear(self) -> None:
        """Forgets a finished migration and compacts the entries."""
        c = self.store.control()
        if c.migration is None:
            return
        if c.migration.active:
            raise MigrationError("MigrationAlreadyActive")
        c.migration = None
        self.store.commit(c)
        self.store.compact()

    # -------- rollback

    @retried
    def begin_rollback(self) -> Migration:
        c = self.store.control()
        if self.b != self.a + 1:
            raise MigrationError("NotSequential", f"{self.a} -> {self.b}")
        if not self.step.reversible:
            raise MigrationError("DownNotSupported", self.step.name)
        m = self._state(c)
        if m.status == ROLLING_BACK:
            return m
        if m.status != COMPLETED:
            raise MigrationError("MigrationNotComplete", m.status)
        c.require(self.b)
        self._fits(c)
        c.migration = Migration(self.a, self.b, 0, c.length(self.b), ROLLING_BACK, c.commits + 1)
        self.store.reset_log(self.a, c)
        self.store.commit(c)
        return c.migration

    def rollback_batch(self, limit: int = DEFAULT_BATCH) -> Outcome:
        return self.rollback_batches(limit)[0]

    @retried
    def rollback_batches(self, limit: int = DEFAULT_BATCH, most: int = 1) -> list[Outcome]:
        """As batches, newest first."""
        self._sized(limit)
        c = self.store.control()
        m = self._state(c)
        if m.status == ROLLED_BACK:
            return [Outcome(self.a, self.b, m.cursor, m.total, done=True)]
        if m.status != ROLLING_BACK:
            raise MigrationError("NoActiveMigration", m.status)
        if c.length(self.b) > m.total:
            raise MigrationError("OrphanedEntries", f"{c.length(self.b) - m.total} keys were written under v{self.b} since the rollback began")
        start, n, counts = m.cursor, min(limit * most, m.total - m.cursor), [NOTHING]
        if n:
            visits = reversed_slice(self.store.log(self.b, c, m.total - start - n, n), m.total, start, n)
            path, counts = self._visit(c, visits, True, F.col("step") - start, limit, n)
            self._keep(c, path, counts)
            self._carry(c, self.b, self.a, visits, n)  # the log of the old version keeps its order: position for position
        m.cursor = start + n
        if m.cursor >= m.total:
            m.status, c.version = ROLLED_BACK, self.a
            c.columns.get(self.step.name, {}).pop(str(self.b), None)  # nothing stands there any more
        self.store.roll(c)
        self.store.commit(c)
        return self._outcomes(m, start, limit, counts)

    def rollback_to_completion(self, limit: int = DEFAULT_BATCH, most: int = 1000, together: int = 1) -> list[Outcome]:
        return _run(self.rollback_batches, limit, most, together)


def _run(batches: Callable[[int, int], list[Outcome]], limit: int, most: int, together: int) -> list[Outcome]:
    out: list[Outcome] = []
    while len(out) < most and not (out and out[-1].done):
        out += batches(limit, min(together, most - len(out)))
    return out


def _within(spark: SparkSession, seconds: float, f: Callable[[], Outcome]) -> Outcome:
    context, group, expired = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        expired.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a batch with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        return f()
    except Exception as e:
        if expired.is_set():
            raise DeadlineExpired(f"no result after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)


# ---------------------------------------------------------------- preflight


def inspect(store: Store) -> dict:
    """What is recorded; never fails."""
    c = store.control()
    v = c.version
    n = c.length(v) if v is not None else 0
    return {"version": v, "index_len": n, "index_entries": -(-n // 32) + 1 if n else 0, "migration_active": bool(c.migration and c.migration.active), "rollback_available": bool(c.migration and c.migration.status == COMPLETED)}


def assert_upgradeable(store: Store, a: int, b: int) -> dict:
    c = store.control()
    c.require(a)
    if c.migration and c.migration.active:
        if c.migration.is_for(a, b):
            return inspect(store)
        raise MigrationError("MigrationAlreadyActive")
    if not c.length(a):
        raise MigrationError("OrphanedEntries", "the log is empty")
    return inspect(store)


def assert_keys_indexed(store: Store, keys: DataFrame, version: int) -> None:
    if orphans(keys, store.log(version)).limit(1).count():
        raise MigrationError("OrphanedEntries", "a live key is not in the log")


def count_orphans(store: Store, keys: DataFrame, version: int) -> int:
    return orphans(keys, store.log(version)).count()
