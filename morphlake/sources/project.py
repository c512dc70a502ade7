"""A project folder: a config file, committed snapshots of shapes and key spaces, plans."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.plans.model import KeySpace, Plan, Shape, ShapeError, ShapeSet

CONFIG = "morphlake.toml"
KEY_SPACE = "keyspace.json"
SNAPSHOT = "version int, name string, note string, fields array<struct<name: string, declared: string, base: string, optional: boolean>>"


@dataclass(frozen=True)
class Config:
    name: str
    migrations: str = "migrations"
    batch: int = 100
    timeout_seconds: int = 120
    sources: tuple[str, ...] = ()  # folders whose Python files declare shapes
    crates: tuple[str, ...] = ()  # names before a type that mean nothing

    @classmethod
    def load(cls, path: Path) -> Config:
        x = tomllib.loads(path.read_text())
        if unknown := set(x) - set(cls.__dataclass_fields__):
            raise ShapeError(f"{path.name}: unknown settings {', '.join(sorted(unknown))}")
        if "name" not in x:
            raise ShapeError(f"{path.name}: name is missing")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()})

    def save(self, path: Path) -> None:
        """Writes what differs from the defaults."""
        plain = Config(self.name)
        lines = [f"{k} = {json.dumps(list(v) if isinstance(v, tuple) else v, ensure_ascii=False)}" for k, v in self.__dict__.items() if k == "name" or v != getattr(plain, k)]
        path.write_text("\n".join(lines) + "\n")


def is_snapshot(name: str) -> bool:
    return name.endswith(".json") and not name.endswith(".plan.json") and name != KEY_SPACE


class Project:
    def __init__(self, root: Path):
        self.root = Path(root)
        self.config = Config.load(self.root / CONFIG)

    @classmethod
    def discover(cls, start: str | Path = ".") -> Project:
        """The project of the nearest folder upwards with a config file."""
        here = Path(start).resolve()
        for folder in (here, *here.parents):
            if (folder / CONFIG).exists():
                return cls(folder)
        raise ShapeError(f"no {CONFIG} in {here} or above")

    @property
    def folder(self) -> Path:
        return self.root / self.config.migrations

    # -------- reading

    def shapes(self) -> ShapeSet:
        """All committed snapshots, by name."""
        files = sorted(p for p in self.folder.glob("*.json") if is_snapshot(p.name)) if self.folder.exists() else []
        out = ShapeSet()
        for p in files:
            try:
                out.insert(Shape.from_json(p.read_text()))
            except (ShapeError, ValueError) as e:
                raise ShapeError(f"{p.name}: {e}") from e
        return out

    def snapshot_table(self, spark: SparkSession) -> DataFrame:
        """The snapshots read by Spark: one row per field."""
        raw = spark.read.schema(SNAPSHOT).option("multiLine", True).option("pathGlobFilter", "*.json").json(str(self.folder))
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        kept = raw.withColumn("__file", name).filter(~F.col("__file").endswith(".plan.json") & (F.col("__file") != KEY_SPACE))
        return kept.select("name", "version", F.posexplode("fields").alias("ord", "f")).select("name", "version", "ord", F.col("f.name").alias("field"), "f.declared", "f.optional")

    def relative(self, path: Path) -> str:
        """A path as people write it: from the project's folder on."""
        return str(path.relative_to(self.root)) if path.is_relative_to(self.root) else str(path)

    def transform_path(self, name: str, a: int, b: int) -> Path:
        return self.folder / f"{name.lower()}_{a}_to_{b}.sql"

    def key_space(self) -> KeySpace | None:
        path = self.folder / KEY_SPACE
        return KeySpace.from_json(path.read_text()) if path.exists() else None

    def plan_path(self, name: str, a: int, b: int) -> Path:
        return self.folder / f"{name.lower()}_{a}_to_{b}.plan.json"

    def plan(self, name: str, a: int, b: int) -> Plan | None:
        path = self.plan_path(name, a, b)
        if not path.exists():
            return None
        found = Plan.from_json(path.read_text())
        if (found.from_version, found.to_version) != (a, b):
            raise ShapeError(f"{path.name} covers v{found.from_version} -> v{found.to_version}")
        return found

    # -------- writing

    def _write(self, path: Path, text: str) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        other = path.with_name(path.name + ".new")
        other.write_text(text)
        os.replace(other, path)

    def write_shape(self, shape: Shape, force: bool = False) -> str:
        """Unchanged, or Written; a snapshot that differs is only replaced by force."""
        path, text = self.folder / shape.file_name, shape.to_json()
        if path.exists():
            if path.read_text() == text:
                return "Unchanged"
            if not force:
                raise ShapeError(f"{path.name} records another shape: a recorded version is not changed, add a new one")
        self._write(path, text)
        return "Written"

    def write_key_space(self, space: KeySpace) -> str:
        path, text = self.folder / KEY_SPACE, space.to_json()
        if path.exists() and path.read_text() == text:
            return "Unchanged"
        self._write(path, text)
        return "Written"

    def write_plan(self, name: str, plan: Plan, force: bool = False) -> Path:
        path = self.plan_path(name, plan.from_version, plan.to_version)
        if path.exists() and not force:
            raise ShapeError(f"{path.name} exists")
        self._write(path, plan.to_json())
        return path

    # -------- declared against committed

    def drift(self, declared: Iterable[Shape]) -> list[tuple[str, int, str]]:
        """(name, version, state): equal, changed, missing (not committed) or undeclared."""
        ours, theirs = {(s.name, s.version): s for s in declared}, {(s.name, s.version): s for s in self.shapes()}
        state = lambda k: "missing" if k not in theirs else "undeclared" if k not in ours else "equal" if ours[k].fields == theirs[k].fields else "changed"
        return [(*k, state(k)) for k in sorted({*ours, *theirs})]


def drift_table(declared: DataFrame, committed: DataFrame) -> DataFrame:
    """name, version, state of (name, version, fields) on both sides: equal, changed, missing (not committed) or undeclared."""
    a, b = declared.withColumnRenamed("fields", "__a"), committed.withColumnRenamed("fields", "__b")
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "undeclared").when(F.col("__a") != F.col("__b"), "changed").otherwise("equal")
    return a.join(b, ["name", "version"], "full_outer").select("name", "version", state.alias("state"))


def package_name(root: Path) -> str:
    """The name in the folder's manifest, else the folder's, else dataset."""
    manifest = Path(root) / "pyproject.toml"
    own = tomllib.loads(manifest.read_text()).get("project", {}).get("name") if manifest.exists() else None
    return own or Path(root).resolve().name or "dataset"


def scaffold(root: Path, name: str | None = None) -> Project:
    root = Path(root)
    path = root / CONFIG
    if path.exists():
        raise ShapeError(f"{path} exists")
    root.mkdir(parents=True, exist_ok=True)
    Config(name or package_name(root)).save(path)
    (root / "migrations").mkdir(exist_ok=True)
    return Project(root)
