"""Coverage checks on bucketed tables: which live keys a log does not know, without moving the log.

The keys of a version's log are kept in a table of the catalog, bucketed by key, which grows by what has been registered
since it was last brought up to date. Keys that are bucketed alike meet them without any exchange; other keys are dealt to the
log's buckets, and the log stays where it is.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.log import contains, orphans, slice_of
from morphlake.sources.store import Store

#: Buckets of a new table: as many as tasks that read it can run at once, and fixed for its lifetime.
BUCKETS = 64
_DONE = "morphlake.positions"


class Coverage:
    """The keys of one version's log as a bucketed table."""

    def __init__(self, store: Store, version: int, buckets: int = BUCKETS):
        self.store, self.version, self.buckets = store, version, buckets
        self.name = f"coverage_{hashlib.sha256(store.root.encode()).hexdigest()[:16]}_v{version}"

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _done(self) -> int:
        if not self.spark.catalog.tableExists(self.name):
            return 0
        found = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}
        return int(found.get(_DONE, 0))

    def refresh(self) -> int:
        """Takes in the positions that are new since the last time and returns how many. Keys are a set here, so a
        refresh that was cut off before its count was kept is harmless. A log that was reset starts the table anew."""
        c = self.store.control()
        length, done = c.length(self.version), self._done()
        if length < done:
            self.drop()
            done = 0
        if length > done or not self.spark.catalog.tableExists(self.name):
            rows = slice_of(self.store.log(self.version, c, done, length - done), done, length - done).select("key")
            save(rows, self.name, self.buckets, f"{self.store.root}/coverage/{uuid.uuid4().hex}")
            self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('{_DONE}' = '{length}')")
        return length - done

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def orphans(self, keys: DataFrame) -> DataFrame:
        """Rows of keys that the log does not know."""
        return orphans(keys, self.keys())

    def contains(self, keys: DataFrame) -> DataFrame:
        return contains(keys, self.keys())

    def drop(self) -> None:
        """The table goes with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.store.folder.delete("coverage")


def save(rows: DataFrame, name: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Appends rows to a table bucketed by key; a new one lies at path. Rows are dealt by bucket first, so that a bucket grows by
    one file a time."""
    there = rows.sparkSession.catalog.tableExists(name)
    writer = rows.repartition(buckets, F.col("key")).write.mode("append").bucketBy(buckets, "key").sortBy("key").format("parquet")
    (writer if there or path is None else writer.option("path", path)).saveAsTable(name)
