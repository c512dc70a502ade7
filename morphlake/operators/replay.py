"""Dry runs: the batches of a migration on a copy of the control record, with an account of each."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.operators.executor import Executor, Outcome
from morphlake.sources.store import Store


class BatchCaller(Protocol):
    def call(self, limit: int) -> tuple[Outcome, dict]: ...


@dataclass
class Replay:
    batches: list[tuple[Outcome, dict]]
    completed: bool
    refused: str | None = None

    @property
    def entries(self) -> int:
        return self.batches[-1][0].total if self.batches else 0

    def total(self, what: str) -> float:
        return sum(x[what] for _, x in self.batches)

    def heaviest(self, first: str = "seconds", second: str = "bytes") -> int | None:
        """The batch with the greatest cost; the last of equal ones."""
        if not self.batches:
            return None
        return max(range(len(self.batches)), key=lambda i: (self.batches[i][1][first], self.batches[i][1][second], i))


def replay(caller: BatchCaller, limit: int, most: int = 1000) -> Replay:
    """Calls batches until one is done; a stall refuses, most leaves it open."""
    got: list[tuple[Outcome, dict]] = []
    while len(got) < most:
        outcome, cost = caller.call(limit)
        if outcome.is_stall:
            return Replay(got, False, f"no progress at {outcome.cursor} of {outcome.total}")
        got.append((outcome, cost))
        if outcome.done:
            return Replay(got, True)
    return Replay(got, False)


class Forked:
    """Batches on a copy: the control record is copied, data files are only read. So many as together says are evaluated by
    one job: their rows are counted each, its seconds and bytes are shared among them by rows."""

    def __init__(self, store: Store, make: Callable[[Store], Executor], root: str | Path, together: int = 1):
        self.store = Store(store.spark, root)
        self.store.record.put(0, store.record.read_text())
        self.executor, self.together = make(self.store), together
        self.begun = False
        self.ready: deque[tuple[Outcome, dict]] = deque()

    def call(self, limit: int) -> tuple[Outcome, dict]:
        if not self.ready:
            began, before = time.time(), self.store.folder.size()
            if not self.begun:
                self.executor.begin()
                self.begun = True
            outcomes = self.executor.batches(limit, self.together)
            seconds, size, n = time.time() - began, self.store.folder.size() - before, sum(o.visited for o in outcomes) or 1
            one = len(outcomes) == 1
            self.ready.extend((o, {"seconds": seconds if one else seconds * o.visited / n, "bytes": size if one else size * o.visited // n, "rows": o.visited}) for o in outcomes)
        return self.ready.popleft()


#: What one batch may use at most, by resource. A cap of none is not held.
Caps = dict[str, float]


def over_cap(costs: DataFrame, caps: Caps) -> DataFrame:
    """Batches that exceed any cap, with the resources they exceed."""
    which = F.filter(F.array(*[F.when(F.col(k) > v, F.lit(k)) for k, v in sorted(caps.items())]), lambda x: x.isNotNull())
    return costs.withColumn("over", which).filter(F.size("over") > 0)


def fits(cost: dict, caps: Caps) -> bool:
    return all(cost[k] <= v for k, v in caps.items())


def caps_tally(costs: DataFrame, caps: Caps, by: str = "run") -> DataFrame:
    """over_cap and fits: batches of each run over any cap and within all."""
    bad = F.lit(False)
    for k, v in caps.items():
        bad = bad | (F.col(k) > v)
    return costs.groupBy(by).agg(F.count_if(bad).alias("over_cap"), F.count_if(~bad).alias("fits"))


def totals(costs: DataFrame, by: str = "run") -> DataFrame:
    """run, total, batches, entries: of (run, batch, instructions, memory, total)."""
    return costs.groupBy(by).agg(F.sum("instructions").alias("total_instructions"), F.count(F.lit(1)).alias("batches"), F.max_by("total", "batch").alias("entries"))


def heaviest(costs: DataFrame, by: str = "run") -> DataFrame:
    best = F.max_by(F.struct("batch", "instructions", "memory"), F.struct("instructions", "memory", "batch"))
    return costs.groupBy(by).agg(best.alias("b")).select(by, "b.batch", "b.instructions", "b.memory")
