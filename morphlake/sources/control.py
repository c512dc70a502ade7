"""The control record: one small JSON text that names everything a reader may see.

Data files are written first and are invisible until a record that lists them is the newest. A
batch is therefore kept whole or not at all, and files of a run that was lost are ignored. Records
are numbered, and the next number can be taken once: a writer that started from an older record
is refused.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from morphlake.plans.compile import Columns
from morphlake.plans.model import ShapeError
from morphlake.sources.files import Record

FORMAT = 1
RUNNING, COMPLETED, ROLLING_BACK, ROLLED_BACK = "Running", "Completed", "RollingBack", "RolledBack"


class MigrationError(Exception):
    """A refused operation. The code of each."""

    CODES = {
        "NotInitialized": 1, "StateNewerThanContract": 2, "VersionMismatch": 3, "MigrationAlreadyActive": 4, "NoActiveMigration": 5, "WrongMigration": 6,
        "BatchTooLarge": 7, "BatchSizeZero": 8, "CorruptIndex": 9, "OrphanedEntries": 10, "MigrationNotComplete": 11, "DownNotSupported": 12,
        "InvalidVersion": 13, "NotSequential": 14, "AlreadyCompleted": 15, "UnknownExecutableTag": 16,
    }

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind, self.code = kind, self.CODES[kind]

    @property
    def retryable(self) -> bool:
        return self.kind in ("MigrationAlreadyActive", "WrongMigration")

    @property
    def requires_code_rollback(self) -> bool:
        return self.kind in ("StateNewerThanContract", "NotInitialized")


@dataclass
class Migration:
    """Progress of a step. There is no failed status: a batch that fails leaves no trace."""

    from_version: int
    to_version: int
    cursor: int
    total: int
    status: str
    started: int = 0  # number of the record that began it

    @property
    def active(self) -> bool:
        return self.status in (RUNNING, ROLLING_BACK)

    @property
    def progress_bp(self) -> int:
        return 10_000 if self.total == 0 else min(self.cursor, self.total) * 10_000 // self.total

    @property
    def remaining(self) -> int:
        return max(self.total - self.cursor, 0)

    def is_for(self, a: int, b: int) -> bool:
        return (self.from_version, self.to_version) == (a, b)


#: So many folders of about one size are merged into one while a store is written.
FAN = 8


def run_of(sizes: list[int | None], fan: int = FAN) -> int | None:
    """Where a run of fan folders of one size class starts at the end of a list: classes are powers of fan, so a
    list of n writes of one size stays within fan times the logarithm of n. None if there is no such run."""
    kind = lambda n: None if n is None else len(_digits(n, fan))
    tail = [kind(n) for n in sizes[-fan:]]
    return len(sizes) - fan if len(tail) == fan and tail[-1] is not None and len(set(tail)) == 1 else None


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, r = divmod(n, base)
        out.append(r)
    return out


@dataclass
class Control:
    format: int = FORMAT
    version: int | None = None
    migration: Migration | None = None
    entries: list[str] = field(default_factory=list)  # folders, oldest first
    logs: dict[str, list[str]] = field(default_factory=dict)  # folders of each version's log
    lengths: dict[str, int] = field(default_factory=dict)
    schema: dict[str, str] = field(default_factory=dict)  # type of every column of the entries
    streams: dict[str, int] = field(default_factory=dict)  # last batch taken in of each stream
    columns: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)  # shape, version, field: the column that holds it
    sizes: dict[str, int] = field(default_factory=dict)  # rows of each folder
    commits: int = 0  # number of this record

    def length(self, version: int) -> int:
        return self.lengths.get(str(version), 0)

    def log(self, version: int) -> list[str]:
        return self.logs.get(str(version), [])

    def add_entries(self, path: str, rows: DataFrame, n: int) -> None:
        """A folder of n rows that are newer than all before."""
        for name, kind in rows.dtypes:
            if self.schema.setdefault(name, kind) != kind:
                raise ValueError(f"{name} is {self.schema[name]} in the store and {kind} in the new rows")
        self.entries.append(path)
        self.sizes[path] = n

    def add_log(self, version: int, path: str, n: int) -> None:
        """n rows at the end of a version's log."""
        self.logs.setdefault(str(version), []).append(path)
        self.lengths[str(version)] = self.length(version) + n
        self.sizes[path] = n

    def share_log(self, a: int, b: int) -> None:
        """The whole log of a version is that of another as well: its folders are named, not written again."""
        self.logs[str(b)] = list(self.log(a))
        self.lengths[str(b)] = self.length(a)

    def replace(self, folders: list[str], first: int, path: str, n: int) -> None:
        """One folder in place of those from first on."""
        old, folders[first:] = folders[first:], [path]
        self.unsized(old)
        self.sizes[path] = n

    def unsized(self, folders: list[str]) -> None:
        """Forgets the sizes of folders that no list names any more."""
        named = self.folders()
        for x in folders:
            if x not in named:
                self.sizes.pop(x, None)

    def folders(self) -> set[str]:
        """All folders that this state reads."""
        return {*self.entries, *(x for paths in self.logs.values() for x in paths)}

    # -------- where fields stand

    def where(self, name: str, version: int) -> dict[str, str]:
        """The column of each field of a version. Before a shape's first step, fields stand under their names."""
        known = self.columns.get(name, {})
        if known and str(version) not in known:
            raise ShapeError(f"where the fields of {name} v{version} stand is not recorded, only v{', v'.join(sorted(known, key=int))}")
        return known.get(str(version), {})

    def placed(self, name: str, version: int, fields: dict[str, str]) -> None:
        self.columns.setdefault(name, {})[str(version)] = dict(fields)

    def layout(self, name: str, a: int, b: int) -> Columns:
        """What the compiler needs to know for a step from a to b."""
        known = self.columns.get(name, {})
        used = frozenset(c for v, fields in known.items() if int(v) <= a for c in fields.values())
        return Columns(self.where(name, a), known.get(str(b), {}), used, self.schema)

    @classmethod
    def load(cls, record: Record, number: int | None = None) -> Control:
        """The newest record, or the one of a number."""
        number, text = record.newest() if number is None else (number, record.at(number))
        if text is None:
            return cls()
        x = json.loads(text)
        if x["format"] != FORMAT:
            raise ValueError(f"the control record has format {x['format']}, this engine reads {FORMAT}: {'newer' if x['format'] > FORMAT else 'older'} than it")
        x["migration"] = Migration(**x["migration"]) if x["migration"] else None
        return cls(**x | {"commits": number})

    def save(self, record: Record) -> bool:
        """Puts the next record; False if another writer has put it."""
        return record.put(self.commits, json.dumps(asdict(self) | {"commits": self.commits + 1}, indent=2) + "\n")

    # -------- version gate

    def require(self, expected: int) -> None:
        if self.version is None:
            raise MigrationError("NotInitialized")
        if self.version > expected:
            raise MigrationError("StateNewerThanContract", f"recorded {self.version}, expected {expected}")
        if self.version < expected:
            raise MigrationError("VersionMismatch", f"recorded {self.version}, expected {expected}")

    def is_behind(self, expected: int) -> bool:
        return self.version is not None and self.version < expected

    @property
    def write_version(self) -> int:
        """The version that live writes are registered under."""
        if self.migration and self.migration.status == RUNNING:
            return self.migration.to_version
        return self.version or 1
