"""The DataFrame forms of the diff, the key-space diff, stale declarations and type texts over chosen cases, against SQL."""

import duckdb
import pytest
from morphlake.functions import types
from morphlake.plans import diff as differ
from morphlake.plans import versions
from morphlake.plans.model import shape
from morphlake.queries import FINDINGS_SQL, STALE_SQL, diff_sql, space_sql
from pyspark.sql import functions as F

#: Pairs of shapes: name, old fields, new fields, declarations (directive, field, value).
CASES = [
    ("same", "owner: Address, amount: u32", "owner: Address, amount: u32", []),
    ("add_optional", "amount: u32", "amount: u32, frozen: Option<bool>", []),
    ("add_optional_init", "amount: u32", "amount: u32, frozen: Option<bool>", [("init", "frozen", "false")]),
    ("add_required", "amount: u32", "amount: u32, frozen: bool", []),
    ("add_required_init", "amount: u32", "amount: u32, frozen: bool", [("init", "frozen", "false")]),
    ("removed", "amount: u32, legacy: u32", "amount: u32", []),
    ("removed_dropped", "amount: u32, legacy: u32", "amount: u32", [("dropped", "legacy", None)]),
    ("retyped", "amount: u32", "amount: i128", []),
    ("retyped_converted", "amount: u32", "amount: i128", [("converted", "amount", "value")]),
    ("retyped_blank", "amount: u32", "amount: i128", [("converted", "amount", "  ")]),
    ("became_optional", "amount: u32", "amount: Option<u32>", []),
    ("became_required", "amount: Option<u32>", "amount: u32", []),
    ("became_required_init", "amount: Option<u32>", "amount: u32", [("init", "amount", "0")]),
    ("renamed", "body: String", "note: String", [("renamed", "body", "note")]),
    ("renamed_undeclared", "body: String", "note: String", []),
    ("renamed_retyped", "body: String", "note_len: u32", [("renamed", "body", "note_len"), ("converted", "note_len", "length(value)")]),
    ("renamed_optional", "body: String", "note: Option<String>", [("renamed", "body", "note")]),
    ("reordered", "owner: Address, amount: u32", "amount: u32, owner: Address", []),
    ("spelling", "frozen: std::option::Option<bool>", "frozen: Option<bool>", []),
    ("three", "amount: u32, legacy: u32, flag: Option<bool>", "amount: i128, flag: bool", []),
    ("placeholder", "amount: u32", "amount: u32, frozen: bool", [("init", "frozen", "<TODO: a value>")]),
]
STALE = [
    ("stale_dropped", "amount: u32", "amount: u32", [("dropped", "amount", None)]),
    ("stale_missing", "amount: u32, legacy: u32", "amount: u32", [("dropped", "legacy", None), ("dropped", "never", None)]),
    ("stale_init", "amount: u32", "amount: u32", [("init", "amount", "1")]),
    ("stale_converted", "amount: u32", "amount: u32, x: Option<u32>", [("converted", "amount", "value")]),
    ("stale_renamed", "a: u32, b: u32", "b: u32", [("renamed", "a", "b"), ("dropped", "a", None)]),
    ("rename_converted", "a: u32", "b: u32", [("renamed", "a", "b"), ("converted", "b", "value")]),
    ("good", "a: u32", "b: u32", [("renamed", "a", "b")]),
    ("good_dropped", "a: u32", "b: u32", [("renamed", "a", "b"), ("dropped", "a", None)]),
    ("good_converted", "a: u32", "b: i128", [("renamed", "a", "b"), ("converted", "b", "value")]),
]


_SPACE_OLD = [("real", 0, "Migration", "MigrationKey", True), ("real", 1, "Balance", "Address", False), ("real", 2, "Stats", None, False), ("real", 3, "Admin", None, False), ("order", 0, "A", None, False), ("order", 1, "B", "u32", False), ("spelled", 0, "A", "std::vec::Vec< u32 >", False), ("unit", 0, "A", None, False)]
_SPACE_NEW = [("real", 0, "Migration", "MigrationKey", False), ("real", 1, "Balance", "u64", True), ("real", 2, "Total", None, False), ("real", 3, "Admin", None, False), ("order", 0, "B", "u32", False), ("order", 1, "A", None, False), ("spelled", 0, "A", "Vec<u32>", False), ("unit", 0, "A", "u32", False)]
_TYPES = [("u32",), (" Option<bool> ",), ("std::option::Option< Vec<u8> >",), ("core::option::Option<Option<u32>>",), ("Option<bool",), ("alloc::vec::Vec<std::string::String>",), ("Map<Symbol, core::primitive::u32>",), ("any_sdk::Address",)]




def sql_values(rows, columns):
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({columns}))"


def fields(cases, side):
    return [(c[0], i, f.name, f.declared) for c in cases for i, f in enumerate(shape("s", 1, c[side]).fields)]


def said(cases):
    return [(c[0], *x) for c in cases for x in c[3]] or [("none", "init", "q", "1")]


def tables(spark, cases):
    old, new = (spark.createDataFrame(fields(cases, s), "pair string, ord int, field string, declared string") for s in (1, 2))
    return old, new, spark.createDataFrame(said(cases), "pair string, directive string, field string, value string")


def sql(cases, rest):
    side = lambda s: sql_values(fields(cases, s), "pair, ord, field, declared")
    return diff_sql(side(1), side(2), sql_values(said(cases), "pair, directive, field, value"), "") + rest


def same(df, text):
    want = duckdb.sql(text)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    assert got == sorted(map(repr, want.select(*order).fetchall())) != []


@pytest.mark.parametrize("cases", [[c for c in CASES if not c[3]], CASES, STALE])
def test_findings(spark, cases):
    same(differ.diff_tables(*tables(spark, cases)), sql(cases, FINDINGS_SQL))


def test_stale(spark):
    old, new, declared = tables(spark, STALE)
    same(differ.stale_tables(declared, differ.diff_tables(old, new, declared), old, new), sql(STALE, STALE_SQL))


def test_key_spaces(spark):
    names = "pair, ord, variant, payload, migration"
    a, b = (spark.createDataFrame(x, "pair string, ord int, variant string, payload string, migration boolean") for x in (_SPACE_OLD, _SPACE_NEW))
    same(differ.key_space_tables(a, b), space_sql(sql_values(_SPACE_OLD, names), sql_values(_SPACE_NEW, names)))


def test_type_texts(spark):
    for (text,) in _TYPES:
        row = spark.createDataFrame([(text,)], "t string").select(types.base_type(F.col("t")), types.is_optional(F.col("t")), types.normalized(F.col("t"), ("any_sdk",))).first()
        assert tuple(row) == (*types.split_option(text), types.normalize_type(text, ("any_sdk",)))


def test_gates(spark):
    pairs = spark.createDataFrame([(None, 1), (1, 1), (2, 1), (1, 2)], "recorded int, expected int")
    assert {(r.recorded, r.gate, r.behind) for r in versions.gates(pairs).filter("expected = 1 or recorded = 1").collect()} == {(None, "NotInitialized", False), (1, "ok", False), (2, "StateNewerThanContract", False), (1, "VersionMismatch", True)}
