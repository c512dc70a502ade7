"""A store as a data source: spark.read.format("morphlake").option("table", ...).load(root).

table is `log` (pos, key; option version, else the recorded one), `status` (one row: what is recorded), or `commits` (one row for
each kept record). The state is that of the newest record when the read is planned, or of option state. The log has a partition
for each piece in which it is stored, and filters on pos leave out the pieces that can't hold such positions before anything is
opened. For entries, Store.entries and Store.read are the way: they merge.

Readers run without a session, so files are opened through pyarrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMAS = {
    "log": "pos bigint, key string",
    "status": "version int, index_len bigint, footprint int, migration_active boolean, rollback_available boolean, status string, from_version int, to_version int, cursor bigint, total bigint, remaining bigint, progress_bp bigint, started bigint, commits bigint",
    "commits": "state bigint, version int, entries int, segments int, status string, cursor bigint",
}


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _records(root: str) -> dict[int, str]:
    """Number and path of each kept record."""
    store, path = _opened(root)
    names = [x.path for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.base_name.startswith("state.")]
    return {int(x.rsplit(".", 2)[-2]): x for x in names}


def _state(root: str, path: str) -> dict:
    store, _ = _opened(root)
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Piece(InputPartition):
    """A piece of the log: its folder, and the positions that the read can want from it."""

    path: str
    low: int
    high: int


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "morphlake"

    @property
    def asked(self) -> str:
        found = self.options.get("table", "status")
        if found not in SCHEMAS:
            raise ValueError(f"table is {found}, not one of {', '.join(SCHEMAS)}")
        return found

    def schema(self) -> str:
        return SCHEMAS[self.asked]

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options) if self.asked == "log" else StateReader(self.options, self.asked)


def _chosen(options: dict) -> tuple[str, dict | None]:
    root = options["path"].rstrip("/")
    records = _records(root)
    number = int(options.get("state", max(records, default=0)))
    if number and number not in records:
        raise ValueError(f"state {number} is not kept")
    return root, _state(root, records[number]) if number else None


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low, self.high = options, 0, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the API's name
        """Takes bounds on pos; they are also checked row by row, so they need not come back."""
        for f in filters:
            if getattr(f, "attribute", None) != ("pos",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)

    def partitions(self) -> list[InputPartition]:
        _, state = _chosen(self.options)
        version = self.options.get("version") or (state or {}).get("version")
        out, start = [], 0
        for path in (state or {}).get("logs", {}).get(str(version), []):
            end = start + state["sizes"][path] - 1
            if end >= self.low and (self.high is None or start <= self.high):
                out.append(Piece(path, self.low, end if self.high is None else self.high))
            start = end + 1
        return out or [Piece("", 0, -1)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = _opened(partition.path)
        for info in store.get_file_info(fs.FileSelector(path)):
            if info.base_name.endswith(".parquet"):
                wanted = [("pos", ">=", partition.low), ("pos", "<=", partition.high)]
                yield from pq.read_table(info.path, columns=["pos", "key"], filters=wanted, filesystem=store).to_batches(max_chunksize=10_000)


class StateReader(DataSourceReader):
    def __init__(self, options: dict, asked: str):
        self.options, self.asked = options, asked

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.asked == "commits":
            root = self.options["path"].rstrip("/")
            for number, path in sorted(_records(root).items()):
                x = _state(root, path)
                m = x["migration"] or {}
                yield number, x["version"], len(x["entries"]), sum(map(len, x["logs"].values())), m.get("status"), m.get("cursor")
            return
        _, x = _chosen(self.options)
        if x is None:
            yield (None, 0, 0, False, False, *[None] * 8, 0)
            return
        m, v = x["migration"], str(x["version"])
        pieces = len(x["logs"].get(v, []))
        left = (m["status"], m["from_version"], m["to_version"], m["cursor"], m["total"], max(m["total"] - m["cursor"], 0), min(m["cursor"], m["total"]) * 10_000 // m["total"] if m["total"] else 10_000, m.get("started", 0)) if m else (None,) * 8
        active = bool(m and m["status"] in ("Running", "RollingBack"))
        yield (x["version"], x["lengths"].get(v, 0), pieces + 1 if pieces else 0, active, bool(m and m["status"] == "Completed"), *left, x["commits"])


def register_sources(spark: SparkSession) -> None:
    """Makes the format known; filters are offered to it from then on in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
