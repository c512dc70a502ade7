"""Tags that point to a build or a snapshot of a dataset, and are moved in one step."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.plans.model import Shape
from morphlake.sources.control import Control, MigrationError
from morphlake.sources.files import Folder, Record
from morphlake.sources.store import Store


class Aliases:
    """tag -> hash, in a record that changes by compare and swap. Tags can't be deleted."""

    def __init__(self, path: str | Path, spark: SparkSession | None = None):
        folder, _, name = str(path).rpartition("/")
        self.record = Record(Folder(folder or ".", spark), name.removesuffix(".json"))

    def _all(self) -> dict[str, str]:
        text = self.record.read_text()
        return json.loads(text) if text else {}

    def _move(self, change: Callable[[dict[str, str]], tuple[str, str]]) -> str:
        """Points a tag to a target; both are chosen again from the tags as they are when another writer was first."""
        while True:
            number, text = self.record.newest()
            tags = json.loads(text) if text else {}
            tag, target = change(tags)
            if self.record.put(number, json.dumps(tags | {tag: target}, indent=2, sort_keys=True) + "\n"):
                return target

    def publish(self, tag: str, target: str) -> None:
        self._move(lambda _: (tag, target))

    def exists(self, tag: str) -> bool:
        return tag in self._all()

    def resolve(self, tag: str) -> str:
        return _known(self._all(), tag)

    def promote(self, live: str, candidate: str) -> str:
        """Both tags must exist; live then points to what candidate points to."""
        return self._move(lambda tags: (live, _known(tags, live) and _known(tags, candidate)))

    def promote_to(self, live: str, target: str) -> None:
        self._move(lambda tags: (live, _known(tags, live) and target))

    def table(self, spark: SparkSession, tag: str) -> DataFrame:
        """The Parquet dataset that a tag points to."""
        return spark.read.parquet(self.resolve(tag))


class StateTags:
    """Tags that point to states of a store. A tagged state is pinned: it can be read however many follow it."""

    def __init__(self, store: Store):
        self.store = store
        self.aliases = Aliases(f"{store.root}/tags", store.spark)

    def _pinned(self, number: int) -> str:
        try:
            self.store.record.pin(number)
        except KeyError as e:
            raise MigrationError("UnknownExecutableTag", f"state {number} is not kept") from e
        return str(number)

    def publish(self, tag: str, number: int | None = None) -> int:
        """Points a tag, new or old, to a state: the newest, if no number is given."""
        number = self.store.control().commits if number is None else number
        self.aliases.publish(tag, self._pinned(number))
        return number

    def exists(self, tag: str) -> bool:
        return self.aliases.exists(tag)

    def resolve(self, tag: str) -> int:
        return int(self.aliases.resolve(tag))

    def promote(self, live: str, candidate: str) -> int:
        """live then points to candidate's state; both must exist."""
        return int(self.aliases.promote(live, candidate))

    def promote_to(self, live: str, number: int) -> None:
        """Back to a state whose number was noted."""
        self.aliases.resolve(live)
        self.aliases.promote_to(live, self._pinned(number))

    def state(self, tag: str) -> Control:
        return self.store.control(self.resolve(tag))

    def entries(self, tag: str, keys: DataFrame | None = None) -> DataFrame:
        """The entries as they were in the tagged state."""
        return self.store.entries(self.state(tag), keys)

    def read(self, tag: str, shape: Shape, mode: str = "strict") -> DataFrame:
        return self.store.read(shape, self.state(tag), mode)

    def release(self) -> list[int]:
        """Lets go of pinned states that no tag points to; a sweep then deletes what only they read. Not while another
        writer is about to tag an old state."""
        gone = sorted({*self.store.record.pins()} - {int(x) for x in self.aliases._all().values()})
        for number in gone:
            self.store.record.unpin(number)
        return gone


def _known(tags: dict[str, str], tag: str) -> str:
    if tag not in tags:
        raise MigrationError("UnknownExecutableTag", tag)
    return tags[tag]


def promoted(tags: DataFrame, moves: DataFrame) -> DataFrame:
    """tag, hash after moves (live, candidate): a self join; unknown tags move nothing."""
    target = moves.join(tags.select(F.col("tag").alias("candidate"), F.col("hash").alias("__new")), "candidate").select(F.col("live").alias("tag"), "__new")
    return tags.join(target, "tag", "left").select("tag", F.coalesce("__new", "hash").alias("hash"))
