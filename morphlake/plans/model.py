"""Versioned shapes, key spaces and plans, with their JSON files.

A shape's identity is (name, version); a set refuses two shapes of one identity.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.functions.types import normalize_type, spark_type, split_option


#: What stands between the parts of a key's text.
_BETWEEN = "\x1f"


class ShapeError(ValueError):
    """A declaration, file or pair of versions that can't be used."""


@dataclass(frozen=True)
class Field:
    name: str
    declared: str

    @property
    def base(self) -> str:
        return split_option(self.declared)[0]

    @property
    def optional(self) -> bool:
        return split_option(self.declared)[1]


@dataclass(frozen=True)
class Shape:
    name: str
    version: int
    fields: tuple[Field, ...]
    note: str | None = None

    def __post_init__(self):
        if self.version < 1:
            raise ShapeError(f"{self.name}: versions start at 1")
        if len({f.name for f in self.fields}) != len(self.fields):
            raise ShapeError(f"{self.name} v{self.version}: a field name stands twice")

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def only_in(self, other: Shape) -> list[Field]:
        """Fields of this shape that the other lacks."""
        return [f for f in self.fields if other.get(f.name) is None]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T._parse_datatype_string(spark_type(f.declared)), True, {"declared": f.declared}) for f in self.fields])

    def summary(self) -> str:
        """One line for the shape and one for each field, for people."""
        width = max((len(f.name) for f in self.fields), default=0)
        return f"{self.name} v{self.version}\n" + "".join(f"  {f.name:<{width}}  {f.declared}  ({'optional' if f.optional else 'required'})\n" for f in self.fields)

    def source(self) -> str:
        """The declaration as a Python class; declaring it gives this shape again."""
        note = "" if self.note is None else f", note={self.note!r}"
        body = "".join(f"    {f.name}: {f.declared!r}\n" for f in self.fields)
        return f"@declared(version={self.version}, name={self.name!r}{note})\nclass {self.name}V{self.version}:\n{body}"

    def ddl(self) -> str:
        return ", ".join(f"{f.name} {spark_type(f.declared)}{'' if f.optional else ' NOT NULL'}" for f in self.fields)

    @property
    def file_name(self) -> str:
        return f"{self.name.lower()}_{self.version}.json"

    def to_json(self) -> str:
        out: dict = {"version": self.version, "name": self.name}
        if self.note is not None:
            out["note"] = self.note
        out["fields"] = [{"name": f.name, "declared": f.declared, "base": f.base, "optional": f.optional} for f in self.fields]
        return json.dumps(out, indent=2) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Shape:
        x = json.loads(text)
        try:
            return cls(x["name"], int(x["version"]), tuple(Field(f["name"], f["declared"]) for f in x["fields"]), x.get("note"))
        except (KeyError, TypeError) as e:
            raise ShapeError(f"not a shape: {e}") from e


def shape(name: str, version: int, fields: str | dict[str, str], note: str | None = None) -> Shape:
    """A shape from `name: type` pairs, in order."""
    pairs = fields.items() if isinstance(fields, dict) else (map(str.strip, x.split(":", 1)) for x in _top_level(fields))
    return Shape(name, version, tuple(Field(n, t) for n, t in pairs), note)


def _top_level(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [x for x in (*out, now) if x.strip()]


@dataclass(frozen=True)
class Variant:
    name: str
    payload: str | None = None
    migration: bool = False

    def normalized(self, crates: tuple[str, ...] = ()) -> str | None:
        return None if self.payload is None else normalize_type(self.payload, crates)


@dataclass(frozen=True)
class KeySpace:
    name: str
    variants: tuple[Variant, ...]

    def __post_init__(self):
        if len({v.name for v in self.variants}) != len(self.variants):
            raise ShapeError(f"{self.name}: a variant stands twice")
        if sum(v.migration for v in self.variants) > 1:
            raise ShapeError(f"{self.name}: only one variant can carry the bookkeeping keys")

    def get(self, name: str) -> Variant | None:
        return next((v for v in self.variants if v.name == name), None)

    @property
    def bookkeeping(self) -> Variant:
        """The marked variant, else the one named Migration."""
        found = next((v for v in self.variants if v.migration), None) or self.get("Migration")
        if found is None:
            raise ShapeError(f"{self.name}: no variant carries the bookkeeping keys")
        return found

    def wrap(self, variant: str, *payload):
        """The key column of a variant: a struct of its name and payload as text."""
        if self.get(variant) is None:
            raise ShapeError(f"{self.name} has no variant {variant}")
        return F.struct(F.lit(variant).alias("variant"), F.array(*[p.cast("string") for p in payload]).alias("payload") if payload else F.array().cast("array<string>").alias("payload"))

    def key(self, variant: str, *payload) -> Column:
        """The key of a variant as a text. Keys of one variant stand together in the order of texts, so a range of
        keys, and the files that hold it, is one variant's."""
        return self.text(self.wrap(variant, *payload))

    @staticmethod
    def text(wrapped: Column) -> Column:
        """The text of a wrapped key: its parts, joined by a character that they then can't hold."""
        safe = lambda x: F.coalesce(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit(_BETWEEN), F.lit("%1f")), F.lit("%00"))
        return F.concat_ws(_BETWEEN, wrapped["variant"], F.transform(wrapped["payload"], safe))

    @staticmethod
    def parts(key: Column) -> Column:
        """The wrapped key of a text: variant and payload."""
        plain = lambda x: F.when(x != "%00", F.replace(F.replace(x, F.lit("%1f"), F.lit(_BETWEEN)), F.lit("%25"), F.lit("%")))
        pieces = F.split(key, _BETWEEN)
        return F.struct(pieces[0].alias("variant"), F.transform(F.slice(pieces, 2, F.size(pieces)), plain).alias("payload"))

    def within(self, variant: str, key: str = "key") -> Column:
        """Whether keys are of a variant: a range, which a scan can use to leave out files."""
        if self.get(variant) is None:
            raise ShapeError(f"{self.name} has no variant {variant}")
        return (F.col(key) >= variant) & (F.col(key) < variant + chr(ord(_BETWEEN) + 1))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "variants": [{"name": v.name, **({} if v.payload is None else {"payload": v.payload}), **({"migration": True} if v.migration else {})} for v in self.variants]}, indent=2) + "\n"

    @classmethod
    def from_json(cls, text: str) -> KeySpace:
        x = json.loads(text)
        return cls(x["name"], tuple(Variant(v["name"], v.get("payload"), bool(v.get("migration", False))) for v in x["variants"]))


@dataclass(frozen=True)
class Plan:
    """What an author has declared about a step from one version to the next."""

    from_version: int
    to_version: int
    init: dict[str, str] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    converted: dict[str, str] = field(default_factory=dict)
    renamed: dict[str, str] = field(default_factory=dict)
    note: str | None = None

    @property
    def empty(self) -> bool:
        return not (self.init or self.dropped or self.converted or self.renamed)

    def renamed_from(self, new: str) -> str | None:
        return next((o for o in sorted(self.renamed) if self.renamed[o] == new), None)

    def renamed_to(self, old: str) -> str | None:
        return self.renamed.get(old)

    def unfilled(self) -> list[str]:
        """Directives that still hold a placeholder."""
        return sorted(k for d in (self.init, self.converted) for k, v in d.items() if v.lstrip().startswith("<TODO"))

    def filled(self) -> Plan:
        """Without placeholders: they declare nothing."""
        gone = set(self.unfilled())
        keep = lambda d: {k: v for k, v in d.items() if k not in gone or not v.lstrip().startswith("<TODO")}
        return Plan(self.from_version, self.to_version, keep(self.init), self.dropped, keep(self.converted), self.renamed, self.note)

    def to_json(self) -> str:
        out: dict = {"from": self.from_version, "to": self.to_version}
        for key, value in (("init", dict(sorted(self.init.items()))), ("dropped", list(self.dropped)), ("converted", dict(sorted(self.converted.items()))), ("renamed", dict(sorted(self.renamed.items()))), ("note", self.note)):
            if value:
                out[key] = value
        return json.dumps(out, indent=2) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Plan:
        x = json.loads(text)
        if unknown := set(x) - {"from", "to", "init", "dropped", "converted", "renamed", "note"}:
            raise ShapeError(f"plan: unknown directives {sorted(unknown)}")
        return cls(int(x["from"]), int(x["to"]), x.get("init", {}), tuple(x.get("dropped", ())), x.get("converted", {}), x.get("renamed", {}), x.get("note"))


class ShapeSet:
    """Shapes by name and version. Shapes are versioned on their own."""

    def __init__(self, shapes: list[Shape] = ()):  # type: ignore[assignment]
        self._shapes: dict[tuple[str, int], Shape] = {}
        for x in shapes:
            self.insert(x)

    def insert(self, new: Shape) -> None:
        old = self._shapes.setdefault((new.name, new.version), new)
        if old != new:
            raise ShapeError(f"{new.name} v{new.version} is recorded with another shape")

    def get(self, name: str, version: int) -> Shape | None:
        return self._shapes.get((name, version))

    def names(self) -> list[str]:
        return sorted({n for n, _ in self._shapes})

    def versions(self, name: str) -> list[int]:
        return sorted(v for n, v in self._shapes if n == name)

    def pairs(self, name: str) -> list[tuple[Shape, Shape]]:
        """Neighbouring recorded versions, gaps included."""
        v = self.versions(name)
        return [(self._shapes[name, a], self._shapes[name, b]) for a, b in zip(v, v[1:])]

    def gaps(self, name: str) -> list[tuple[int, int]]:
        return [(a.version, b.version) for a, b in self.pairs(name) if b.version != a.version + 1]

    def next_version(self, name: str) -> int:
        return max(self.versions(name), default=0) + 1

    def latest(self, name: str) -> Shape | None:
        v = self.versions(name)
        return self._shapes[name, v[-1]] if v else None

    def __iter__(self):
        return iter(self._shapes[k] for k in sorted(self._shapes))

    def table(self, spark: SparkSession) -> DataFrame:
        """name, version, ord, field, declared: one row per field."""
        rows = [(s.name, s.version, i, f.name, f.declared) for s in self for i, f in enumerate(s.fields)]
        return spark.createDataFrame(rows, "name string, version int, ord int, field string, declared string")


class ShapeFields:
    """A table function: the fields of a shape from its JSON text, one row each. In SQL after register():
    SELECT t.* FROM files, LATERAL shape_fields(files.value) t."""

    COLUMNS = "name string, version int, ord int, field string, declared string, base string, optional boolean"

    def eval(self, text: str):
        if text is None:
            return
        found = Shape.from_json(text)
        for i, f in enumerate(found.fields):
            yield found.name, found.version, i, f.name, f.declared, f.base, f.optional


def register(spark: SparkSession) -> None:
    """Makes shape_fields known to SQL."""
    spark.udtf.register("shape_fields", F.udtf(ShapeFields, returnType=ShapeFields.COLUMNS))
