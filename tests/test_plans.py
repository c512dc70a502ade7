import random
from collections import defaultdict

import pytest
from morphlake.functions.types import normalize_type, spark_type, split_option
from morphlake.plans.compile import FunctionStep, checked, compile_additive, compile_step, draft
from morphlake.plans.diff import StaleDirective, diff, diff_tables, key_space_diff, stale_tables, verdicts
from morphlake.plans.model import Field, KeySpace, Plan, Shape, ShapeError, ShapeSet, Variant, shape
from test_shapes_sql import CASES, STALE, tables
from pyspark.sql import functions as F

EXPECTED = {
    "same": ([], "Safe"),
    "add_optional": ([("frozen", "AddedOptional", 1)], "SafeWithLazyMigration"),
    "add_optional_init": ([("frozen", "AddedOptional", 0)], "Safe"),
    "add_required": ([("frozen", "AddedRequired", 2)], "Denied"),
    "add_required_init": ([("frozen", "AddedRequired", 1)], "SafeWithLazyMigration"),
    "removed": ([("legacy", "Removed", 2)], "Denied"),
    "removed_dropped": ([("legacy", "Removed", 0)], "Safe"),
    "retyped": ([("amount", "Retyped", 2)], "Denied"),
    "retyped_converted": ([("amount", "Retyped", 1)], "SafeWithLazyMigration"),
    "retyped_blank": ([("amount", "Retyped", 2)], "Denied"),
    "became_optional": ([("amount", "BecameOptional", 0)], "Safe"),
    "became_required": ([("amount", "BecameRequired", 2)], "Denied"),
    "became_required_init": ([("amount", "BecameRequired", 1)], "SafeWithLazyMigration"),
    "renamed": ([("note", "Renamed", 0)], "Safe"),
    "renamed_undeclared": ([("note", "AddedRequired", 2), ("body", "Removed", 2)], "Denied"),
    "renamed_retyped": ([("note_len", "Renamed", 1)], "SafeWithLazyMigration"),
    "renamed_optional": ([("note", "Renamed", 1)], "SafeWithLazyMigration"),
    "reordered": ([("", "Reordered", 0)], "Safe"),
    "spelling": ([("frozen", "SpellingChanged", 0)], "Safe"),
    "three": ([("amount", "Retyped", 2), ("flag", "BecameRequired", 2), ("legacy", "Removed", 2)], "Denied"),
    "placeholder": ([("frozen", "AddedRequired", 2)], "Denied"),
}


def case(name, old, new, declared):
    plan = Plan(
        1, 2,
        {f: v for d, f, v in declared if d == "init"},
        tuple(f for d, f, _ in declared if d == "dropped"),
        {f: v for d, f, v in declared if d == "converted"},
        {f: v for d, f, v in declared if d == "renamed"},
    )
    return shape("s", 1, old), shape("s", 2, new), plan


@pytest.mark.parametrize("c", CASES, ids=[c[0] for c in CASES])
def test_decision_table(c):
    # a conversion that is blank, or a directive that a placeholder leaves undeclared, is no stale one
    d = diff(*case(*c))
    findings, verdict = EXPECTED[c[0]]
    assert [(f.field, f.kind, f.severity) for f in d.findings] == findings
    assert d.verdict == verdict


def test_tables_agree_with_the_driver(spark):
    old, new, declared = tables(spark, CASES)
    found = diff_tables(old, new, declared).collect()
    got = {c[0]: [(r.field, r.kind, r.severity) for r in sorted(found, key=lambda r: r.place) if r.pair == c[0]] for c in CASES}
    assert got == {n: f for n, (f, _) in EXPECTED.items()}
    assert {r.pair: r.verdict for r in verdicts(old, diff_tables(old, new, declared)).collect()} == {n: v for n, (_, v) in EXPECTED.items()}


@pytest.mark.parametrize("c", STALE, ids=[c[0] for c in STALE])
def test_stale_directives_are_errors(c):
    if c[0].startswith("good"):
        diff(*case(*c))
        return
    with pytest.raises(StaleDirective):
        diff(*case(*c))


def test_both_forms_agree_on_random_plans(spark):
    r, cases = random.Random(3), []
    kinds = ["u32", "i128", "Option<u32>", "std::option::Option<u32>", "kit::Address", "Address", "Vec<u8>", "std::vec::Vec<u8>"]
    for k in range(300):
        old, new = ({n: r.choice(kinds) for n in r.sample("abcde", r.randint(1, 4))} for _ in range(2))
        renamed = {a: b for a, b in zip(r.sample("abcde", 2), r.sample("abcde", 2), strict=True)} if r.random() < 0.6 else {}
        some = lambda values: {n: r.choice(values) for n in r.sample("abcde", r.randint(0, 2))} if r.random() < 0.5 else {}
        given = [("init", n, v) for n, v in some(["1", "<TODO: x>"]).items()] + [("dropped", n, None) for n in some([""])] + [("converted", n, v) for n, v in some(["value", " ", "<TODO: y>"]).items()] + [("renamed", a, b) for a, b in renamed.items()]
        cases.append((str(k), *(", ".join(f"{n}: {t}" for n, t in x.items()) for x in (old, new)), given))
    old, new, declared = tables(spark, cases)
    table = diff_tables(old, new, declared, ("kit",)).cache()
    findings, stale = defaultdict(list), defaultdict(set)
    for x in table.orderBy("pair", "place").collect():
        findings[x.pair].append((x.field, x.kind, x.severity))
    for x in stale_tables(declared, table, old, new).collect():
        stale[x.pair].add((x.directive, x.field))
    refused = 0
    for c in cases:
        try:
            d = diff(*case(*c), ("kit",))
        except StaleDirective as e:
            refused += 1
            assert (e.directive, e.name) in stale[c[0]], c
        else:
            assert not stale[c[0]], c
            assert [(f.field, f.kind, f.severity) for f in d.findings] == findings[c[0]], c
    assert 50 < refused < 290


def test_additive_and_hand_written_steps(spark):
    a, b = shape("s", 1, "x: u32, old: u32"), shape("s", 2, "x: u32, y: Option<u32>")
    step = compile_additive(a, b, {"y": "x + 1"}, ("old",))
    own = FunctionStep("s", 1, 2, {"x": "bigint", "y": "bigint"}, lambda c: {"y": F.coalesce(c["y"], c["x"] + 1)}, lambda c: {"y": F.lit(None)})
    rows = spark.createDataFrame([(1, None), (2, 9), (None, None)], "x bigint, y bigint")
    for s in (step, own):
        once = s.up(rows)
        assert {(r.x, r.y, r.outcome) for r in once.collect()} == {(1, 2, "Migrated"), (2, 9, "AlreadyCurrent"), (None, None, "AlreadyCurrent")}
        assert {r.outcome for r in s.up(once.drop("outcome")).collect()} == {"AlreadyCurrent"}
        assert {r.y for r in s.down(once.drop("outcome")).collect()} == {None}
    with pytest.raises(ShapeError, match="is needed"):
        compile_additive(a, a)
    with pytest.raises(ShapeError, match="write a plan"):
        compile_additive(shape("s", 1, "x: u32, z: u32"), shape("s", 2, "x: i128"), dropped=("z",))


def test_versions_move_by_one():
    a = shape("s", 1, "x: u32")
    with pytest.raises(ShapeError, match="skips"):
        diff(a, shape("s", 3, "x: u32"))
    with pytest.raises(ShapeError, match="come after"):
        diff(shape("s", 2, "x: u32"), a)
    with pytest.raises(ShapeError, match="covers"):
        diff(a, shape("s", 2, "x: u32"), Plan(4, 5))


def test_key_space():
    old = KeySpace("K", (Variant("Migration", "MigrationKey", True), Variant("Balance", "Address"), Variant("Stats")))
    assert key_space_diff(old, old) == []
    assert [f.kind for f in key_space_diff(old, KeySpace("Other", tuple(reversed(old.variants))))] == ["Reordered"]
    renamed = KeySpace("K", (old.variants[0], Variant("Holding", "Address"), old.variants[2]))
    assert [(f.field, f.kind, f.severity) for f in key_space_diff(old, renamed)] == [("Holding", "VariantAdded", 0), ("Balance", "VariantRemoved", 2)]
    moved = KeySpace("K", (Variant("Migration", "MigrationKey"), Variant("Balance", "u64", True), Variant("Stats")))
    assert [f.kind for f in key_space_diff(old, moved)] == ["MarkerMoved", "PayloadChanged", "MarkerMoved"]
    assert old.bookkeeping.name == "Migration"
    assert KeySpace.from_json(old.to_json()) == old


def test_shape_files_and_sets():
    a = shape("Balance", 1, "owner: Address, m: Map<Symbol, u32>", note="first")
    assert Shape.from_json(a.to_json()) == a and a.file_name == "balance_1.json"
    s = ShapeSet([a, shape("Balance", 2, "owner: Address"), shape("Balance", 4, "owner: Address")])
    s.insert(a)
    assert s.versions("Balance") == [1, 2, 4] and s.gaps("Balance") == [(2, 4)] and s.next_version("Balance") == 5 and s.next_version("new") == 1
    with pytest.raises(ShapeError):
        s.insert(shape("Balance", 1, "other: u32"))
    with pytest.raises(ShapeError):
        Shape("x", 0, ())
    with pytest.raises(ShapeError):
        Shape("x", 1, (Field("a", "u32"), Field("a", "u32")))
    p = Plan(1, 2, {"a": "1"}, ("b",), {"c": "value"}, {"d": "e"}, "n")
    assert Plan.from_json(p.to_json()) == p


def test_types():
    assert split_option(" core::option::Option< u32 > ") == ("u32", True)
    assert split_option("Option<Option<u32>>") == ("Option<u32>", True)
    assert split_option("Option<bool") == ("Option<bool", False)
    assert normalize_type("alloc::vec::Vec< std::string::String >") == "Vec<String>"
    assert spark_type("Option<Vec<u32>>") == "array<bigint>" and spark_type("Map<Symbol, Vec<u32>>") == "map<string,array<bigint>>" and spark_type("BytesN<32>") == "binary"


def test_expressions_are_checked():
    assert checked("coalesce(value, 'rand()')")
    for bad in ("rand()", "(select 1)", "", "<TODO: x>", "1; 2", "1 -- x", "current_date()"):
        with pytest.raises(ShapeError):
            checked(bad)


def test_draft_and_refusals():
    a, b = shape("s", 1, "amount: u32, legacy: u32"), shape("s", 2, "amount: i128, frozen: bool")
    d = diff(a, b)
    p = draft(d)
    assert p.dropped == ("legacy",) and p.unfilled() == ["amount", "frozen"]
    with pytest.raises(ShapeError, match="placeholders"):
        compile_step(diff(a, b, p))
    with pytest.raises(ShapeError, match="denied"):
        compile_step(d)


def test_compiled_step_runs_twice_without_change(spark):
    a = shape("s", 1, "owner: Address, amount: u32, body: String, legacy: u32")
    b = shape("s", 2, "owner: Address, amount: i128, note: Option<String>, frozen: Option<bool>")
    step = compile_step(diff(a, b, Plan(1, 2, {"frozen": "false"}, ("legacy",), {"amount": "value * 10"}, {"body": "note"})))
    rows = spark.createDataFrame([("x", 5, "hi", 1), ("y", None, None, None)], "owner string, amount bigint, body string, legacy bigint")
    once = step.up(rows)
    got = {r.owner: (r["amount__v2"], r.note, r.frozen, r.outcome, r.amount) for r in once.collect()}
    assert got == {"x": (50, "hi", False, "Migrated", None), "y": (None, None, False, "Migrated", None)}
    twice = step.up(once.drop("outcome"))
    assert {r.outcome for r in twice.collect()} == {"AlreadyCurrent"}
    assert sorted(map(str, twice.drop("outcome").collect())) == sorted(map(str, once.drop("outcome").select(twice.drop("outcome").columns).collect()))
    assert "transform(array(`amount`)" in step.sql()
