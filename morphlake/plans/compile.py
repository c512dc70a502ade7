"""Plans compiled to DataFrame transforms.

A step reads rows in which fields of both versions may be present (all nullable) and returns
the fields of the new version, the source columns it has consumed (null again) and `outcome`:
Migrated, AlreadyCurrent, or Skipped for a key without an entry and an entry of another shape.
Every rule is guarded by null, so running a step twice changes nothing the second time.

A field whose type changes gets a column of its own, named after the version, so that files of
both versions can be read as one table. Where the fields of each version stand is kept in the store's
record (Columns), so that the next step starts from the columns in which the last one left the values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.types import spark_type
from morphlake.plans.diff import Diff, diff
from morphlake.plans.model import Plan, Shape, ShapeError

MIGRATED, CURRENT, SKIPPED = "Migrated", "AlreadyCurrent", "Skipped"
#: What an expression of a plan can't contain, since a row's result must not hang on when or where it runs.
_FORBIDDEN = re.compile(r"\b(select|exists|rand|randn|random|uuid|now|current_\w+|monotonically_increasing_id|spark_partition_id|input_file_name|shuffle|localtimestamp|unix_timestamp\s*\(\s*\))\b", re.I)


def checked(text: str) -> str:
    """An expression of a plan, if it is deterministic and of one row."""
    plain = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", text)
    if not text.strip() or text.lstrip().startswith("<TODO"):
        raise ShapeError("an expression is not filled in")
    if ";" in plain or "--" in plain or "/*" in plain:
        raise ShapeError("an expression can't contain comments or several statements")
    if m := _FORBIDDEN.search(plain):
        raise ShapeError(f"an expression can't contain {m[0]}")
    return text


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def converted(old: str, text: str) -> str:
    """SQL of a conversion, in which `value` is the old value."""
    return f"transform(array({quoted(old)}), value -> {text})[0]"


@dataclass
class Step:
    """A compiled migration from one version of a shape to the next."""

    name: str
    from_version: int
    to_version: int
    columns: dict[str, str]  # column of each field of the new version -> SQL
    changed: list[str]  # SQL conditions, any of which makes a row Migrated
    consumed: list[str]  # columns that are null afterwards
    types: dict[str, str]  # type of every column, old and new
    back: dict[str, str] = field(default_factory=dict)  # column -> SQL of the inverse
    undone: list[str] = field(default_factory=list)  # SQL conditions of the inverse
    reversible: bool = True
    source: dict[str, str] = field(default_factory=dict)  # field of the old version -> column
    physical: dict[str, str] = field(default_factory=dict)  # field of the new version -> column

    @property
    def is_noop(self) -> bool:
        return not self.changed

    def _run(self, rows: DataFrame, sets: dict[str, str], conditions: list[str], shape_col: str | None) -> DataFrame:
        for name, kind in self.types.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        there = F.col("_present") if "_present" in rows.columns else F.lit(True)
        ours = there & (F.coalesce(F.col(shape_col) == self.name, F.lit(True)) if shape_col else F.lit(True))
        touched: Column = F.lit(False)
        for c in conditions:
            touched = touched | F.expr(f"coalesce({c}, false)")
        outcome = F.when(~ours, SKIPPED).when(touched, MIGRATED).otherwise(CURRENT)
        kept = [F.col(quoted(c)) for c in rows.columns if c not in sets]
        made = [F.when(ours, F.expr(sql).cast(self.types[c])).otherwise(F.col(quoted(c))).alias(c) for c, sql in sets.items()]
        return rows.select(*kept, *made, outcome.alias("outcome"))

    def up(self, rows: DataFrame, shape_col: str | None = None) -> DataFrame:
        sets = {**self.columns, **{c: "NULL" for c in self.consumed}}
        return self._run(rows, {c: s for c, s in sets.items() if s != quoted(c)}, self.changed, shape_col)

    def down(self, rows: DataFrame, shape_col: str | None = None) -> DataFrame:
        if not self.reversible:
            raise ShapeError(f"{self.name}: v{self.to_version} can't be taken back")
        return self._run(rows, self.back, self.undone, shape_col)

    def sql(self, source: str = "entries") -> str:
        """The same step as a SELECT, for review."""
        body = ",\n".join(f"  CAST({s} AS {self.types[c].upper()}) AS {quoted(c)}" for c, s in self.columns.items())
        cond = " OR ".join(f"coalesce({c}, false)" for c in self.changed) or "false"
        return f"SELECT key,\n{body},\n  CASE WHEN {cond} THEN '{MIGRATED}' ELSE '{CURRENT}' END AS outcome\nFROM {source}\n"


@dataclass(frozen=True)
class Columns:
    """Where a store keeps a shape's fields, for compile_step."""

    old: dict[str, str] = field(default_factory=dict)  # of the old version's fields; others are named as they are
    new: dict[str, str] = field(default_factory=dict)  # of the new version's, if its step has begun before
    used: frozenset[str] = frozenset()  # columns of any version that is recorded
    types: dict[str, str] = field(default_factory=dict)  # of all columns there are

    def free(self, name: str, version: int, kind: str, taken: dict[str, str]) -> str:
        """A column for a new field: its name, or the name and the version where an earlier version's values stand."""
        found = name
        while found in self.used or found in taken or self.types.get(found, kind) != kind:
            found = f"{name}__v{version}" if found == name else f"{found}_"
        return found


def compile_step(d: Diff, columns: Columns | None = None) -> Step:
    """The transform of a diff with its plan, over the columns in which a store keeps the fields."""
    old, new = d.from_shape, d.to_shape
    plan = d.plan or Plan(old.version, new.version)
    if plan.unfilled():
        raise ShapeError(f"placeholders are left for {', '.join(plan.unfilled())}")
    if d.undeclared() or d.verdict == "Denied":
        raise ShapeError("the step is denied:\n" + d.report())
    columns = columns or Columns()
    was = {f.name: columns.old.get(f.name, f.name) for f in old.fields}
    kinds = {f.field: f for f in d.findings}
    step = Step(new.name, old.version, new.version, {}, [], [], {was[f.name]: spark_type(f.declared) for f in old.fields}, source=was)
    for f in new.fields:
        found = kinds.get(f.name)
        kind = found.kind if found else None
        column = columns.new.get(f.name)
        if column is not None and columns.types.get(column, spark_type(f.declared)) != spark_type(f.declared):
            column = None  # begun, dropped and declared anew with another type
        if column is None and f.name in was and kind not in ("Retyped", "Renamed"):
            column = was[f.name]
        elif column is None and kind == "Retyped":
            column = columns.free(f"{f.name}__v{new.version}", new.version, spark_type(f.declared), step.types)
        elif column is None:
            column = columns.free(f.name, new.version, spark_type(f.declared), step.types)
        step.physical[f.name] = column
        step.types[column] = spark_type(f.declared)
        c = quoted(column)
        if kind in ("Renamed", "Retyped"):
            source = was[found.old] if kind == "Renamed" else was[f.name]
            text = plan.converted.get(f.name)
            value = converted(source, checked(text)) if text else quoted(source)
            step.columns[column] = f"coalesce({c}, {value})"
            step.changed.append(f"{quoted(source)} IS NOT NULL")
            step.consumed.append(source)
            step.back |= {source: f"coalesce({quoted(source)}, {c})", column: "NULL"}
            step.undone.append(f"{c} IS NOT NULL")
            step.reversible &= not text
        elif f.name in plan.init:
            text = checked(plan.init[f.name])
            step.columns[column] = f"coalesce({c}, {text})"
            step.changed.append(f"{c} IS NULL AND ({text}) IS NOT NULL")
            if kind in ("AddedOptional", "AddedRequired"):
                step.back[column] = "NULL"
                step.undone.append(f"{c} IS NOT NULL")
        else:
            step.columns[column] = c
            if kind in ("AddedOptional", "AddedRequired"):
                step.back[column] = "NULL"
                step.undone.append(f"{c} IS NOT NULL")
    return step


def compile_additive(old: Shape, new: Shape, init: dict[str, str] | None = None, dropped: tuple[str, ...] = ()) -> Step:
    """A step that only fills new fields and drops old ones, without a plan file. Conversions and
    renames are refused, as is a step that does neither."""
    if not init and not dropped:
        raise ShapeError(f"{new.name}: a value for a new field or a dropped field is needed")
    found = diff(old, new, Plan(old.version, new.version, dict(init or {}), tuple(dropped)))
    if other := [f for f in found.findings if f.kind in ("Retyped", "Renamed")]:
        raise ShapeError(f"{new.name}: {', '.join(f.field for f in other)} changes its type or name; write a plan")
    return compile_step(found)


@dataclass
class FunctionStep:
    """A step written by hand: functions from the columns of a row to its new columns.

    forward and backward get the columns of types by name and return those they set, as expressions
    of one row. A row is Migrated if any of them differs from what was there.
    """

    name: str
    from_version: int
    to_version: int
    types: dict[str, str]
    forward: Callable[[dict[str, Column]], dict[str, Column]]
    backward: Callable[[dict[str, Column]], dict[str, Column]] | None = None
    physical: dict[str, str] = field(default_factory=dict)  # field of the new version -> column, where it moves
    consumed: tuple[str, ...] = ()  # columns that forward can't do without

    @property
    def reversible(self) -> bool:
        return self.backward is not None

    def _run(self, rows: DataFrame, f: Callable, shape_col: str | None) -> DataFrame:
        for name, kind in self.types.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        there = F.col("_present") if "_present" in rows.columns else F.lit(True)
        ours = there & (F.coalesce(F.col(shape_col) == self.name, F.lit(True)) if shape_col else F.lit(True))
        made = {c: x.cast(self.types[c]) for c, x in f({c: F.col(quoted(c)) for c in self.types}).items()}
        touched: Column = F.lit(False)
        for c, x in made.items():
            touched = touched | ~x.eqNullSafe(F.col(quoted(c)))
        outcome = F.when(~ours, SKIPPED).when(touched, MIGRATED).otherwise(CURRENT)
        kept = [F.when(ours, made[c]).otherwise(F.col(quoted(c))).alias(c) if c in made else F.col(quoted(c)) for c in rows.columns]
        return rows.select(*kept, outcome.alias("outcome"))

    def up(self, rows: DataFrame, shape_col: str | None = None) -> DataFrame:
        return self._run(rows, self.forward, shape_col)

    def down(self, rows: DataFrame, shape_col: str | None = None) -> DataFrame:
        if self.backward is None:
            raise ShapeError(f"{self.name}: v{self.to_version} can't be taken back")
        return self._run(rows, self.backward, shape_col)


@dataclass
class VariantStep:
    """A step over entries whose fields stand in one VARIANT column, so that entries of many shapes share a
    store. Fields are taken out by name as their types (null where missing or of another type), the step runs over them,
    and what it migrates is put back as a new object."""

    step: Step
    column: str = "value"
    source: dict[str, str] = field(default_factory=dict)
    physical: dict[str, str] = field(default_factory=dict)
    consumed: tuple[str, ...] = ()

    name = property(lambda self: self.step.name)
    from_version = property(lambda self: self.step.from_version)
    to_version = property(lambda self: self.step.to_version)
    reversible = property(lambda self: self.step.reversible)

    def _run(self, rows: DataFrame, run: Callable, shape_col: str | None, fields: list[str]) -> DataFrame:
        names = {c: f"__outer_{c}" for c in rows.columns if c != "_present"}
        value = F.col(quoted(self.column))
        taken = [F.try_variant_get(value, f"$['{n}']", kind).alias(n) for n, kind in self.step.types.items()]
        opened = rows.select(*(["_present"] if "_present" in rows.columns else []), *(F.col(quoted(c)).alias(o) for c, o in names.items()), *taken)
        done = run(opened, names.get(shape_col))
        there = F.col(quoted(names[self.column])).isNotNull()
        made = F.when((F.col("outcome") == MIGRATED) & there, F.to_variant_object(F.struct(*map(quoted, fields)))).otherwise(F.col(quoted(names[self.column])))
        outcome = F.when(there, F.col("outcome")).otherwise(SKIPPED)
        return done.select(*(["_present"] if "_present" in rows.columns else []), *(made.alias(c) if c == self.column else F.col(quoted(o)).alias(c) for c, o in names.items()), outcome.alias("outcome"))

    def up(self, rows: DataFrame, shape_col: str | None = None) -> DataFrame:
        return self._run(rows, self.step.up, shape_col, list(self.step.physical.values()))

    def down(self, rows: DataFrame, shape_col: str | None = None) -> DataFrame:
        return self._run(rows, self.step.down, shape_col, list(self.step.source.values()))


def draft(d: Diff) -> Plan:
    """A plan with a placeholder for every denied finding."""
    init, conv, dropped = {}, {}, []
    for f in d.undeclared():
        if f.directive == "init":
            init[f.field] = "<TODO: an expression for rows without a value>"
        elif f.directive in ("converted", "renamed"):
            conv[f.field] = "<TODO: an expression of value>"
        else:
            dropped.append(f.field)
    return Plan(d.from_shape.version, d.to_shape.version, init, tuple(dropped), conv)
