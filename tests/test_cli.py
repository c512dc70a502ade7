import json

import pytest
from morphlake.cli import main
from morphlake.functions.numbers import join_versions, percent_of
from morphlake.functions.types import compact
from morphlake.operators.decode import decode, optional_number, status_view, validate
from morphlake.operators.log import slice_of, with_positions
from morphlake.plans import versions
from morphlake.plans.model import Plan, ShapeError, ShapeSet, shape
from morphlake.sources import declare
from morphlake.sources.declare import declared
from morphlake.sources.project import Config, Project, package_name, scaffold
from morphlake.sources.store import Store
from pyspark.sql import functions as F


@pytest.fixture
def project(tmp_path):
    p = scaffold(tmp_path / "p", "vault")
    p.write_shape(shape("Balance", 1, "owner: Address, amount: i64"))
    p.write_shape(shape("Balance", 2, "owner: Address, amount: i64, frozen: bool"))
    return p


def test_check_plan_generate(project, capsys):
    at = ["--project", str(project.root)]
    pick = ["--schema", "Balance", "--from", "1", "--to", "2"]
    assert main([*at, "check"]) == 2
    assert main([*at, "generate", *pick]) == 2
    assert main([*at, "plan"]) == 0 and main([*at, "plan"]) == 1
    assert main([*at, "generate", *pick]) == 2 and main([*at, "check"]) == 2  # a placeholder declares nothing
    project.write_plan("Balance", Plan(1, 2, {"frozen": "false"}), force=True)
    capsys.readouterr()
    assert main([*at, "check", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["migrations"][0]["verdict"] == "SafeWithLazyMigration"
    assert main([*at, "check", "--fail-on", "warn"]) == 2
    assert main([*at, "generate", *pick]) == 0 and main([*at, "generate", *pick]) == 1
    assert main(["--project", "/", "check"]) == 1


def test_run_and_rollback(spark, project, tmp_path, capsys):
    project.write_plan("Balance", Plan(1, 2, {"frozen": "false"}))
    store = Store(spark, tmp_path / "store")
    store.initialize(1)
    store.put(spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit("o").alias("owner"), F.col("id").alias("amount")))
    at = ["--project", str(project.root)]
    pick = ["--schema", "Balance", "--from", "1", "--to", "2", "--store", str(store.root), "--batch", "8"]
    assert main([*at, "dry-run", *pick]) == 0 and main([*at, "run", *pick]) == 0 and store.control().version == 1
    assert main([*at, "dry-run", *pick, "--cap", "rows=8"]) == 0 and main([*at, "dry-run", *pick, "--cap", "rows=7"]) == 2
    assert "over a cap: batches 0, 1" in capsys.readouterr().out
    assert main([*at, "run", *pick, "--submit"]) == 0 and store.control().version == 2
    assert main([*at, "status", *pick]) == 0
    assert '"batches_left": 0' in capsys.readouterr().out
    assert main([*at, "rollback", *pick]) == 0 and store.control().version == 1
    assert main([*at, "adopt", "--store", str(store.root), "--version", "0"]) == 2


@pytest.fixture
def spaces():
    saved = declare.KEY_SPACES[:]
    declare.KEY_SPACES.clear()
    yield declare.KEY_SPACES
    declare.KEY_SPACES[:] = saved


def report(project, capsys, *more):
    capsys.readouterr()
    code = main(["--project", str(project.root), "check", "--json", *more])
    return code, json.loads(capsys.readouterr().out)


def test_check_of_the_key_space(project, capsys, spaces):
    project.write_plan("Balance", Plan(1, 2, {"frozen": "false"}))
    assert report(project, capsys)[0] == 0
    old = declare.key_space("Keys", ("Migration", "MigrationKey", True), ("Balance", ("Address", "u32")), "Stats")
    assert old.get("Balance").payload == "Address, u32"
    code, got = report(project, capsys)
    assert code == 2 and "no keyspace.json is committed" in got["drift"][0]["detail"]  # no baseline
    project.write_key_space(old)
    assert report(project, capsys)[0] == 0
    spaces.clear()
    declare.key_space("Other", ("Migration", "MigrationKey", True), ("Balance", ("Address", "u32")), "Stats")
    code, got = report(project, capsys)
    assert code == 0 and [x["severity"] for x in got["drift"]] == ["info"]  # only variants are encoded
    cases = [
        ([("Migration", "MigrationKey", True), ("Balance", "Address, u32"), "Stats", "New"], 0, ["info"]),
        ([("Migration", "MigrationKey", True), "Stats", ("Balance", "Address, u32")], 0, ["info"]),
        ([("Migration", "MigrationKey", True), ("Balance", "u64"), "Stats"], 2, ["deny"]),
        ([("Migration", "MigrationKey"), ("Balance", "Address, u32", True), "Stats"], 2, ["deny", "deny"]),
        ([("Migration", "MigrationKey", True), ("Balance", "Address, u32")], 2, ["deny"]),
        ([("Migration", "MigrationKey", True), ("Holding", "Address, u32"), "Stats"], 2, ["info", "deny"]),
    ]
    for variants, want, severities in cases:
        spaces.clear()
        declare.key_space("Keys", *variants)
        code, got = report(project, capsys)
        assert (code, [x["severity"] for x in got["drift"]]) == (want, severities), variants
    declare.key_space("Second", "A")
    code, got = report(project, capsys)
    assert code == 2 and "Keys, Second" in got["drift"][0]["detail"]
    spaces.clear()
    (project.root / "src").mkdir()
    Config("vault", sources=("src",)).save(project.root / "morphlake.toml")
    code, got = report(Project(project.root), capsys)
    assert code == 2 and "no key space is declared" in got["drift"][0]["detail"]


def test_check_names_families_jumps_and_missing_transforms(project, capsys, spaces):
    project.write_plan("Balance", Plan(1, 2, {"frozen": "false"}))
    code, got = report(project, capsys, "--fail-on", "warn")
    assert code == 2 and got["migrations"][0]["notes"][0]["severity"] == "warn" and got["summary"] == {"pairs": 1, "denied": 0, "broken": 0}
    assert main(["--project", str(project.root), "generate", "--schema", "Balance", "--from", "1", "--to", "2"]) == 0
    assert report(project, capsys)[1]["migrations"][0]["notes"] == [{"severity": "info", "detail": "transform at migrations/balance_1_to_2.sql"}]
    project.write_shape(shape("EntryV1", 1, "a: u32"))
    project.write_shape(shape("EntryV2", 1, "a: u32"))
    project.write_shape(shape("Balance", 4, "owner: Address"))
    code, got = report(project, capsys)
    assert code == 2 and got["drift"][0]["shape"] == "EntryV1, EntryV2" and got["summary"] == {"pairs": 2, "denied": 1, "broken": 1} and got["verdict"] == "deny"
    capsys.readouterr()
    assert main(["--project", str(project.root), "check"]) == 2
    assert "2 version pairs, 1 denied, 1 broken snapshot; verdict: deny" in capsys.readouterr().out


def test_list_and_show(project, capsys):
    project.write_shape(shape("Balance", 4, "owner: Address", note="last"))
    project.write_plan("Balance", Plan(1, 2, {"frozen": "false"}))
    at = ["--project", str(project.root), "schema"]
    capsys.readouterr()
    assert main([*at, "list"]) == 0
    assert capsys.readouterr().out.splitlines() == ["Balance: 1, 2, 4", "  v1 -> v2: plan, no transform", "  v2 -> v4: no plan, no transform", "  v2 -> v4: skips versions"]
    assert main([*at, "list", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["pairs"][0] == {"from": 1, "to": 2, "plan": True, "transform": False}
    assert main([*at, "show"]) == 0
    assert capsys.readouterr().out == "Balance v4\n  owner  Address  (required)\nnote: last\n"
    assert main([*at, "show", "--version", "2", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["version"] == 2
    assert main([*at, "show", "--version", "3"]) == 1 and main([*at, "list", "--schema", "None"]) == 1


def test_sources_are_walked(project, capsys, spaces, tmp_path):
    head = "from morphlake.sources.declare import declared, key_space\n"
    for name, text in (("b.py", head + 'key_space("Walked", "A")\n'), ("a.py", head + '@declared(version=1)\nclass Walked:\n    """Seen\n    on the way."""\n    x: "u32"\n'), (".x/c.py", "raise 1"), ("build/d.py", "raise 1"), ("e.py", "raise 1")):
        path = project.root / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert [p.name for p in declare.sources(project.root / "src")] == ["a.py", "b.py", "e.py"]
    Config("vault", sources=("src",), batch=7).save(project.root / "morphlake.toml")
    assert (project.root / "morphlake.toml").read_text() == 'name = "vault"\nbatch = 7\nsources = ["src"]\n'
    p = Project(project.root)
    assert p.config == Config("vault", sources=("src",), batch=7)
    at = ["--project", str(project.root), "schema"]
    assert main([*at, "--check"]) == 2 and main(at) == 0
    assert "is committed and not declared" in capsys.readouterr().out
    assert p.shapes().get("Walked", 1).note == "Seen on the way." and p.key_space().name == "Walked"
    again = {}
    exec(head + p.shapes().get("Balance", 2).source(), again)  # rendered and declared again
    assert again["BalanceV2"].shape == p.shapes().get("Balance", 2)
    assert compact("Map< Symbol ,  Vec< u32 > >") == "Map<Symbol, Vec<u32>>" and p.relative(p.folder / "x") == "migrations/x"
    (tmp_path / "named").mkdir()
    (tmp_path / "named" / "pyproject.toml").write_text('[project]\nname = "own"\n')
    assert package_name(tmp_path / "named") == "own" and package_name(tmp_path) == tmp_path.name


def test_snapshots(spark, project):
    with pytest.raises(ShapeError, match="another shape"):
        project.write_shape(shape("Balance", 1, "owner: Address"))
    assert project.write_shape(shape("Balance", 1, "owner: Address, amount: i64")) == "Unchanged"
    assert Project.discover(project.folder).config == Config("vault")
    assert {(r.version, r.field) for r in project.snapshot_table(spark).collect()} == {(1, "owner"), (1, "amount"), (2, "owner"), (2, "amount"), (2, "frozen")}
    drift = project.drift([shape("Balance", 1, "owner: Address, amount: i64"), shape("New", 1, "a: u32")])
    assert drift == [("Balance", 1, "equal"), ("Balance", 2, "undeclared"), ("New", 1, "missing")]
    (project.root / "morphlake.toml").write_text('name = "x"\nother = 1\n')
    with pytest.raises(ShapeError, match="unknown"):
        Project(project.root)


def test_declared_classes():
    @declared(version=1)
    class Thing:
        a: "u32"
        b: "Option<bool>"

    assert [(f.name, f.declared) for f in Thing.shape.fields] == [("a", "u32"), ("b", "Option<bool>")]
    with pytest.raises(ShapeError):
        declared(version=1, colour="red")


def test_decode(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "key string, x bigint")
    need, may = shape("s", 1, "x: i64"), shape("s", 1, "x: i64, y: Option<String>")
    assert validate(rows, need) == 1
    with pytest.raises(Exception, match="x is missing"):
        decode(rows, need).collect()
    assert [r["_decode_ok"] for r in decode(rows, may, "skip", ("key",)).orderBy("key").collect()] == [True, False]


def test_json_views(spark):
    rows = spark.createDataFrame([(1, '{"from": 1, "to": "2", "cursor": 5, "total": 9, "status": "RollingBack"}')], "k int, j string")
    assert tuple(status_view(rows, "j", ("k",)).first()) == (1, 1, 2, 5, 9, "RollingBack", True)
    with pytest.raises(Exception, match="total is missing"):
        status_view(rows.withColumn("j", F.lit('{"from": 1, "to": 2, "cursor": 3, "status": "x"}')), "j").collect()
    texts = spark.createDataFrame([("7",), ('"8"',), (" ",), (None,), ("null",)], "t string")
    assert [r[0] for r in texts.select(optional_number(F.col("t"))).collect()] == [7, 8, None, None, None]


def test_versions_of_tables_and_sets(spark):
    versions_ = [("a", 1), ("a", 2), ("a", 4), ("b", 3)]
    table, own = spark.createDataFrame(versions_, "name string, version int"), ShapeSet([shape(n, v, "x: u32") for n, v in versions_])
    assert {(r.name, r.version, r.next_version) for r in versions.pairs(table).collect()} == {(n, a.version, b.version) for n in own.names() for a, b in own.pairs(n)}
    assert {(r.name, r.version, r.next_version) for r in versions.gaps(table).collect()} == {(n, *g) for n in own.names() for g in own.gaps(n)}
    assert {(r.name, r.latest, r.next_version) for r in versions.summary(table).collect()} == {(n, own.latest(n).version, own.next_version(n)) for n in own.names()}


def test_slices_tile_the_log(spark, tmp_path):
    log = with_positions(spark.range(137).withColumnRenamed("id", "key"), ["key"], str(tmp_path / "log")).cache()
    whole = [r.key for r in log.orderBy("pos").collect()]
    tiles = [r.key for i in range(0, 160, 32) for r in slice_of(log, i, 32).orderBy("pos").collect()]
    assert tiles == whole == list(range(137))
    assert slice_of(log, 137, 5).count() == 0 and slice_of(log, 5, 0).count() == 0


def test_reports():
    assert [join_versions(v) for v in ([], [1], [1, 2], [1, 2, 3], [1, 3, 4])] == ["none", "1", "1, 2", "1-3", "1, 3, 4"]
    assert percent_of(1, 0) == "n/a" and percent_of(1, 16) == "6.2%"
