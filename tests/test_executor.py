import json

import pytest
from morphlake.operators.decode import decode_variant
from morphlake.operators.executor import DeadlineExpired, Executor, assert_keys_indexed, assert_upgradeable, count_orphans, inspect, report
from morphlake.operators.log import get
from morphlake.operators.replay import Forked, replay
from morphlake.plans.compile import FunctionStep, VariantStep, compile_step
from morphlake.plans.diff import diff
from morphlake.plans.model import KeySpace, Plan, ShapeError, Variant, register, shape
from morphlake.sources.aliases import Aliases, StateTags
from morphlake.sources.coverage import Coverage, save
from morphlake.sources.control import MigrationError, run_of
from morphlake.sources.files import KEPT, Folder, Record
from morphlake.sources.store import Conflict, Store
from morphlake.sources.tables import LogReader, register_sources
from morphlake.streaming.follow import ingest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

STEP = compile_step(diff(shape("Entry", 1, "amount: u32"), shape("Entry", 2, "amount: u32, frozen: Option<bool>"), Plan(1, 2, {"frozen": "false"})))


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.format_string("k%05d", "id").alias("key"), F.col("id").alias("amount"))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, tmp_path / "store")
    s.initialize(1)
    return s


def refused(kind, f, *args):
    with pytest.raises(MigrationError) as e:
        f(*args)
    assert e.value.kind == kind


def test_batches_cover_the_log(spark, store):
    store.put(rows(spark, 10))
    assert sorted(r.pos for r in store.log(1).collect()) == list(range(10))
    run = Executor(store, STEP)
    assert run.begin().total == 10
    got = run.run_to_completion(4)
    assert [(o.cursor, o.visited, o.migrated, o.done) for o in got] == [(4, 4, 4, False), (8, 4, 4, False), (10, 2, 2, True)]
    assert store.control().version == 2 and store.control().length(2) == 10
    assert {r.frozen for r in store.entries().collect()} == {False}
    again = run.batch(4)
    assert again.done and again.visited == 0
    refused("VersionMismatch" if store.control().version < 1 else "StateNewerThanContract", run.begin)
    assert inspect(store)["rollback_available"]
    run.clear()
    assert len(store.control().entries) == 1 and store.entries().count() == 10


def test_abort_resume_and_growth(spark, store):
    store.put(rows(spark, 6))
    run = Executor(store, STEP)
    run.begin()
    run.batch(3)
    run.abort()
    refused("NoActiveMigration", run.abort)
    run.begin()
    first = run.batch(3)
    assert (first.migrated, first.already_current) == (0, 3)
    store.register(1, rows(spark, 4, 100).select("key"))  # keys that are registered but have no entry
    rest = run.run_to_completion(10)
    assert rest[-1].total == 10 and sum(o.skipped for o in rest) == 4
    assert store.control().length(2) == 13  # a log, not a set: the aborted batch had registered 3 keys


def test_guards(spark, store):
    run = Executor(store, STEP)
    refused("BatchSizeZero", run.batch, 0)
    refused("BatchTooLarge", run.batch, 151)
    refused("NoActiveMigration", run.batch, 10)
    refused("OrphanedEntries", assert_upgradeable, store, 1, 2)
    refused("NoActiveMigration", run.begin_rollback)
    refused("InvalidVersion", store.adopt, 0)
    refused("VersionMismatch", store.initialize, 2)
    store.initialize(1)
    empty = Executor(Store(spark, f"{store.root}/none"), STEP)
    refused("NotInitialized", empty.begin)
    run.begin()
    other = compile_step(diff(shape("E", 1, "a: u32"), shape("E", 2, "a: u32, b: Option<u32>"), Plan(1, 2)))
    other.from_version, other.to_version = 2, 3
    refused("WrongMigration", Executor(store, other).batch, 5)
    assert assert_upgradeable(store, 1, 2)["migration_active"]
    refused("MigrationAlreadyActive", run.clear)
    assert MigrationError("CorruptIndex").code == 9 and MigrationError("WrongMigration").retryable


def test_a_failing_row_leaves_no_trace(spark, store):
    bad = compile_step(diff(shape("Entry", 1, "amount: u32"), shape("Entry", 2, "amount: u32, half: Option<u32>"), Plan(1, 2, {"half": "if(amount = 7, raise_error('poison'), amount)"})))
    store.put(rows(spark, 10))
    run = Executor(store, bad)
    run.begin()
    run.batch(5)
    before = json.loads(store.record.read_text())
    with pytest.raises(Exception, match="poison"):
        run.batch(5)
    assert json.loads(store.record.read_text()) == before
    assert "half" in store.entries().columns and store.entries().filter("half is not null").count() == 5


def test_rollback_walks_newest_first(spark, store):
    store.put(rows(spark, 10))
    run = Executor(store, STEP)
    run.begin()
    refused("MigrationNotComplete", run.begin_rollback)
    run.run_to_completion(100)
    assert run.begin_rollback().total == 10
    run.rollback_batch(3)
    assert sorted(r.key for r in store.entries().filter("frozen is null").collect()) == ["k00007", "k00008", "k00009"]
    run.rollback_to_completion(4)
    assert store.control().version == 1 and store.entries().filter("frozen is not null").count() == 0
    assert [r.key for r in store.log(1).orderBy("pos").collect()] == [f"k{i:05d}" for i in range(10)]


def test_rollback_refuses_growth(spark, store):
    store.put(rows(spark, 5))
    run = Executor(store, STEP)
    run.begin()
    run.run_to_completion(100)
    run.begin_rollback()
    store.register(2, rows(spark, 1, 50).select("key"))
    refused("OrphanedEntries", run.rollback_batch, 5)


def test_remove_orphans_duplicates(spark, store):
    store.put(rows(spark, 5))
    store.register(1, rows(spark, 2).select("key"))  # registered twice
    store.put_unindexed(rows(spark, 1, 30))
    assert count_orphans(store, store.entries().select("key"), 1) == 1
    refused("OrphanedEntries", assert_keys_indexed, store, store.entries().select("key"), 1)
    store.remove(rows(spark, 1, 4).select("key"))
    run = Executor(store, STEP)
    run.begin()
    (o,) = run.run_to_completion(100)
    assert (o.visited, o.migrated, o.already_current, o.skipped) == (7, 4, 2, 1)


def test_dry_run_changes_nothing(spark, store, tmp_path):
    store.put(rows(spark, 7))
    before = store.record.read_text()
    got = replay(Forked(store, lambda s: Executor(s, STEP), tmp_path / "fork"), 3)
    assert got.completed and got.entries == 7 and got.total("rows") == 7 and got.heaviest() is not None
    assert store.record.read_text() == before
    assert not replay(Forked(store, lambda s: Executor(s, STEP), tmp_path / "fork2"), 3, most=1).completed


def test_aliases(tmp_path):
    a = Aliases(tmp_path / "tags.json")
    a.publish("live", "x")
    refused("UnknownExecutableTag", a.promote, "live", "next")
    a.publish("next", "y")
    assert a.promote("live", "next") == "y" and a.resolve("live") == "y" and a.exists("next")


def test_a_put_during_a_batch_is_kept(spark, store):
    store.put(rows(spark, 6))
    run = Executor(store, STEP)
    run.begin()
    visit, late = run._visit, []

    def slow(*args, **kwargs):
        out = visit(*args, **kwargs)
        if not late:
            late.append(store.put(rows(spark, 3, 100).withColumn("amount", F.lit(7).cast("bigint"))))
            store.put(rows(spark, 1).withColumn("amount", F.lit(99).cast("bigint")))  # a newer row of a key of the batch
        return out

    run._visit = slow
    got = run.batch(4)
    assert (got.visited, got.cursor) == (4, 4)
    run.run_to_completion(100)
    have = {r.key: (r.amount, r.frozen) for r in store.entries().collect()}
    assert len(have) == 9 and have["k00000"] == (99, False) and have["k00005"] == (5, False)
    assert sorted(r.pos for r in store.log(2).collect()) == list(range(store.control().length(2)))


def test_two_writers_and_one_number(spark, store):
    a, b = store.control(), store.control()
    store.commit(a)
    with pytest.raises(Conflict):
        store.commit(b)
    old = store.control()
    for _ in range(3):
        store.commit(store.control())
    for name in store.folder.names("state.")[:-1]:  # as if they had been cleaned up
        store.folder.delete(name)
    number = store.control().commits
    with pytest.raises(Conflict):
        store.commit(old)
    assert store.control().commits == number


def test_files_of_another_file_system(spark, store, tmp_path):
    far = Folder(f"{tmp_path}/far", spark)
    far.local, far.root = False, f"file://{tmp_path}/far"  # through Spark's file systems
    record = Record(far, "state")
    assert record.newest() == (0, None) and record.put(0, "a") and not record.put(0, "b") and record.put(1, "ü")
    assert record.newest() == (2, "ü") and far.size() > 0
    far.delete("")
    assert far.names("state.") == []


def test_a_batch_reads_its_own_entries(spark, store):
    store.put(rows(spark, 4000).repartition(8))
    keys = rows(spark, 20, 1000).select("key")
    plan = store.entries(keys=keys)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,k01000)" in plan and "LessThanOrEqual(key,k01019)" in plan
    assert store.entries(keys=keys).count() == 20


def test_deadline(spark, store):
    store.put(rows(spark, 5))
    run = Executor(store, STEP)
    run.begin()
    visit = run._visit

    def stuck(*args, **kwargs):
        spark.range(8).select(F.udf(lambda i: __import__("time").sleep(30))("id")).collect()
        return visit(*args, **kwargs)

    run._visit = stuck
    with pytest.raises(DeadlineExpired):
        run.batch_within(5, 2)
    assert store.control().migration.cursor == 0
    run._visit = visit
    assert run.batch_within(5, 60).done
    assert [tuple(r)[:4] for r in report(spark, [run.batch(5)]).collect()] == [(0, 1, 2, 5)]


def test_positions_are_dense(spark, store):
    store.put(rows(spark, 5))
    log = store.log(1)
    assert get(log, 3, 5) == "k00003" and get(log, 5, 5) is None
    refused("CorruptIndex", get, log.filter("pos <> 2"), 2, 5)


def test_stream_takes_each_entry_once(spark, store, tmp_path):
    landing = str(tmp_path / "landing")
    for i in range(3):
        rows(spark, 200, 200 * i).coalesce(1).write.mode("append").parquet(landing)
        ingest(spark, landing, "key string, amount bigint", store, str(tmp_path / "cp"), Executor(store, STEP)).awaitTermination()
        assert store.entries().count() == 200 * (i + 1)
    assert store.entries().filter("frozen = false").count() == 600 and store.control().version == 2
    assert not store.put(rows(spark, 5, 900), stream=("landing", 1))  # given twice
    assert store.entries().count() == 600


V = {
    1: shape("Item", 1, "price: f64, old: Option<String>"), 2: shape("Item", 2, "price: i64, old: Option<String>"), 3: shape("Item", 3, "price: i128"),
    4: shape("Item", 4, "cost: i128, old: Option<String>"),
}
PLANS = {1: Plan(1, 2, converted={"price": "cast(round(value * 100) as bigint)"}), 2: Plan(2, 3, {}, ("old",), {"price": "value * 10"}), 3: Plan(3, 4, renamed={"price": "cost"})}


def step_to(store, v):
    return store.compile(diff(V[v], V[v + 1], PLANS[v]))


def run_to(store, last):
    for v in range(store.control().version, last):
        run = Executor(store, step_to(store, v), strict=False)
        run.begin()
        assert run.run_to_completion(100)[-1].done
    return run


def items(spark, n):
    return spark.range(n).select(F.format_string("k%03d", "id").alias("key"), (F.col("id") + 0.25).alias("price"), F.lit("x").alias("old"))


def test_chained_steps_keep_their_values(spark, store):
    store.put(items(spark, 10), shape=V[1])
    run = run_to(store, 4)
    c = store.control()
    assert c.where("Item", 4)["cost"] == "cost" and c.where("Item", 3)["price"] == "price__v3" and c.version == 4
    read = {r.key: (int(r.cost), r.old) for r in store.read(V[4]).collect()}
    assert read == {f"k{i:03d}": (i * 1000 + 250, None) for i in range(10)}  # a dropped field that comes again is empty
    with pytest.raises(ShapeError, match="not recorded"):
        store.read(shape("Item", 7, "cost: i128"))
    # live writes by shape land in the right columns, and are read beside the others
    store.put(spark.sql("select 'new' key, cast(7 as decimal(38,0)) cost, 'y' old"), shape=V[4])
    assert {(r.key, int(r.cost), r.old) for r in store.read(V[4]).filter("key = 'new' or old is not null").collect()} == {("new", 7, "y")}
    # the last step is taken back, and taken again
    run.begin_rollback()
    assert run.rollback_to_completion(100)[-1].done
    assert {r.key: int(r.price) for r in store.read(V[3]).collect()} == {**{f"k{i:03d}": i * 1000 + 250 for i in range(10)}, "new": 7}
    assert "4" not in store.control().columns["Item"]
    refused("MigrationAlreadyActive", run.begin)  # until the record of the rollback is cleared
    run.clear()
    run_to(store, 4)
    assert store.read(V[4]).filter("cost is null").count() == 0 and store.control().migration.started > 0


def test_steps_for_other_columns_are_refused(spark, store):
    store.put(items(spark, 3), shape=V[1])
    run_to(store, 2)
    plain = compile_step(diff(V[2], V[3], PLANS[2]))  # knows nothing of price__v2
    with pytest.raises(ShapeError, match="price stands in price__v2"):
        Executor(store, plain).begin()
    assert store.control().migration.status == "Completed"
    other = Store(spark, f"{store.root}-other")
    other.initialize(1)
    other.put(rows(spark, 2))
    with pytest.raises(ShapeError, match="no column price"):
        Executor(other, step_to(other, 1)).begin()


def test_columns_of_a_shape_outlive_abort_and_hand_written_steps(spark, store):
    store.put(items(spark, 6), shape=V[1])
    run = Executor(store, step_to(store, 1))
    run.begin()
    run.batch(2)
    run.abort()
    assert step_to(store, 1).physical == run.step.physical  # what was done is found again
    run_to(store, 2)
    own = FunctionStep("Item", 2, 3, {"price__v2": "bigint"}, lambda x: {"price__v2": F.coalesce(x["price__v2"], F.lit(0)) * 1})
    hand = Executor(store, own)
    hand.begin()
    hand.run_to_completion(10)
    same = shape("Item", 3, "price: i64, old: Option<String>")
    assert {r.price for r in store.read(same).collect()} == {i * 100 + 25 for i in range(6)}


def test_tags_on_states(spark, store):
    tags = StateTags(store)
    store.put(rows(spark, 5))
    refused("UnknownExecutableTag", tags.promote, "live", "next")
    one = tags.publish("live")
    refused("UnknownExecutableTag", tags.promote, "live", "next")
    assert tags.resolve("live") == one and not tags.exists("next")
    store.put(rows(spark, 1).withColumn("amount", F.lit(77).cast("bigint")))
    tags.publish("next")
    store.compact()
    for _ in range(KEPT + 3):
        store.commit(store.control())  # so many that the tagged records are no longer kept
    assert not store.folder.read(store.record._name(one))
    assert tags.promote("live", "next") == tags.resolve("next")
    assert tags.entries("live").filter("amount = 77").count() == 1
    tags.promote_to("live", one)
    assert {r.amount for r in tags.entries("live").collect()} == set(range(5)) == {r.amount for r in tags.read("live", shape("Entry", 1, "amount: u32")).collect()}
    refused("UnknownExecutableTag", tags.promote_to, "live", 2 if one > 2 else 1)
    refused("UnknownExecutableTag", tags.promote_to, "nowhere", one)
    tags.promote_to("next", one)
    assert tags.release() == [n for n in [one + 1] if n not in store.record.pins()] and store.record.pins() == [one]


def test_sweep_keeps_what_states_name_and_what_is_new(spark, store):
    tags = StateTags(store)
    store.put(rows(spark, 5))
    tags.publish("old")
    run = Executor(store, STEP)
    run.begin()
    run.run_to_completion(3)
    run.clear()
    under_way = store.write(rows(spark, 2, 50), "entries")  # a writer that has not committed yet
    assert store.sweep() == [] == store.sweep(age=60)
    for name in store.folder.names("state.")[:-1]:
        store.folder.delete(name)
    gone = store.sweep(age=-1)
    assert any(x.startswith("visits/") for x in gone) and f"entries/{under_way.rsplit('/', 1)[1]}" in gone
    assert store.entries().filter("frozen = false").count() == 5 and tags.entries("old").count() == 5 and store.log(2).count() == 5
    assert store.sweep(age=-1) == []


def test_lists_of_a_record_stay_short(spark, store):
    sizes, longest = [], {}
    for n in range(1, 501):
        sizes.append(150)
        while (first := run_of(sizes)) is not None:
            sizes[first:] = [sum(sizes[first:])]
        longest[n] = max(len(sizes), longest.get(n - 1, 0))
    assert sum(sizes) == 500 * 150 and longest[500] < 2 * longest[50]
    store.put(rows(spark, 60))
    run = Executor(store, STEP)
    run.begin()
    run.run_to_completion(3)
    c = store.control()
    assert len(c.entries) <= 7 and len(c.log(2)) <= 12 and sum(c.sizes[x] for x in c.log(2)) == 60
    assert store.entries().filter("frozen = false").count() == 60
    assert [(r.first_pos, r.length) for r in store.segments(2).orderBy("segment").collect()][0] == (0, 24) and store.footprint(2) == len(c.log(2)) + 1
    assert sorted(r.pos for r in store.log(2).collect()) == list(range(60))
    store.remove(rows(spark, 10).select("key"))
    for i in range(9):
        store.put_unindexed(rows(spark, 1, 100 + i))
    assert store.entries().count() == 59  # a removal outlives the merge of its folder


def test_a_batch_is_counted_by_the_job_that_writes_it(spark, store):
    store.put(rows(spark, 9))
    store.register(1, rows(spark, 3).select("key"))
    run = Executor(store, STEP)
    run.begin()
    (o,) = run.run_to_completion(100)
    assert (o.visited, o.migrated, o.already_current, o.skipped) == (12, 9, 3, 0)


def test_errors_say_what_to_do():
    assert MigrationError("StateNewerThanContract").requires_code_rollback and MigrationError("NotInitialized").requires_code_rollback
    assert not MigrationError("BatchSizeZero").requires_code_rollback and not MigrationError("BatchSizeZero").retryable


def test_promote_to_a_target(tmp_path):
    a = Aliases(tmp_path / "tags.json")
    refused("UnknownExecutableTag", a.promote_to, "live", "z")
    a.publish("live", "x")
    a.promote_to("live", "z")
    assert a.resolve("live") == "z"


SPACE = KeySpace("K", (Variant("A", "u32"), Variant("AB", "(u32, Address)"), Variant("Stats"), Variant("Migration", None, True)))


def test_keys_of_variants(spark):
    texts = ["plain", "", None, "%", "%1f", "a\x1fb", "%00", "é%25"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").select("t", "i", SPACE.key("AB", F.col("i"), F.col("t")).alias("key"))
    for r in df.withColumn("p", SPACE.parts(F.col("key"))).collect():
        assert (r.p.variant, r.p.payload) == ("AB", [str(r.i), r.t])
    unit = df.select(SPACE.key("Stats").alias("key")).withColumn("p", SPACE.parts(F.col("key"))).first()
    assert unit.key == "Stats" and unit.p.payload == []
    both = df.select("key").unionAll(df.select(SPACE.key("A", F.col("i"))))
    assert both.filter(SPACE.within("A")).count() == both.filter(SPACE.within("AB")).count() == len(texts)
    with pytest.raises(ShapeError):
        SPACE.within("Nothing")


def test_variants_share_a_store(spark, store):
    a = spark.range(6).select(SPACE.key("A", F.col("id")).alias("key"), F.to_variant_object(F.struct(F.col("id").alias("amount"))).alias("value"))
    b = spark.range(4).select(SPACE.key("AB", F.col("id"), F.lit("x")).alias("key"), F.parse_json(F.lit('{"amount": "seven", "key": 1}')).alias("value"))
    store.put(a)
    store.put(b)
    store.register(1, spark.range(6, 8).select(SPACE.key("A", F.col("id")).alias("key")))  # keys without entries
    step = VariantStep(compile_step(diff(shape("Entry", 1, "amount: i64"), shape("Entry", 2, "total: i64, frozen: Option<bool>"), Plan(1, 2, {"frozen": "amount > 2"}, renamed={"amount": "total"}))))
    run = Executor(store, step, variant=(SPACE, "A"))
    run.begin()
    (o,) = run.run_to_completion(100)
    assert (o.visited, o.migrated, o.already_current, o.skipped) == (12, 6, 0, 6)
    now = store.entries()
    got = decode_variant(now.filter(SPACE.within("A")), "value", shape("Entry", 2, "total: i64, frozen: Option<bool>"), keep=("key",))
    assert {r.key: (r.total, r.frozen) for r in got.collect()} == {f"A\x1f{i}": (i, i > 2) for i in range(6)}
    assert {r.v for r in now.filter(SPACE.within("AB")).select(F.to_json("value").alias("v")).collect()} == {'{"amount":"seven","key":1}'}
    read = decode_variant(now, "value", shape("Entry", 2, "total: i64"), "skip", keep=("key",))
    assert read.filter("_decode_ok").count() == 6 and read.count() == 10
    with pytest.raises(Exception, match="total is missing"):
        decode_variant(now, "value", shape("Entry", 2, "total: i64")).collect()
    plan = store.entries(keys=a.select("key"))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(key,A\x1f5)" in plan  # files of other variants lie outside of this range
    run.begin_rollback()
    run.rollback_to_completion(100)
    back = decode_variant(store.entries().filter(SPACE.within("A")), "value", shape("Entry", 1, "amount: i64"))
    assert sorted(r.amount for r in back.collect()) == list(range(6))


def test_table_function(spark):
    register(spark)
    texts = [shape("E", 2, "a: u32, b: Option<Vec<u32>>").to_json(), shape("F", 1, "").to_json(), None]
    files = spark.createDataFrame([(t,) for t in texts], "text string")
    got = spark.sql("SELECT t.* FROM {files} f, LATERAL shape_fields(f.text) t", files=files).collect()
    assert sorted(map(tuple, got)) == [("E", 2, 0, "a", "u32", "u32", False), ("E", 2, 1, "b", "Option<Vec<u32>>", "Vec<u32>", True)]


def test_the_data_source_opens_the_pieces_it_needs(spark, store):
    register_sources(spark)
    read = lambda table, **more: spark.read.format("morphlake").options(table=table, **more).load(store.root)
    assert read("log").count() == 0 and read("status").first().version == 1
    store.put(rows(spark, 9))
    run = Executor(store, STEP)
    run.begin()
    run.run_to_completion(3, most=2)
    got = read("log", version="2").filter("pos >= 1 and pos < 4 and key <> 'k00002'")
    assert sorted((r.pos, r.key) for r in got.collect()) == [(1, "k00001"), (3, "k00003")]
    reader = LogReader({"path": store.root, "version": "2"})
    left = list(reader.pushFilters([GreaterThan(("pos",), 2), LessThanOrEqual(("pos",), 5), EqualTo(("key",), "x")]))
    assert left == [EqualTo(("key",), "x")] and [(p.low, p.high) for p in reader.partitions()] == [(3, 5)]
    s = read("status").first()
    assert (s.version, s.index_len, s.status, s.cursor, s.remaining, s.progress_bp, s.migration_active, s.commits) == (1, 9, "Running", 6, 3, 6666, True, store.control().commits)
    commits = {r.state: r for r in read("commits").collect()}
    assert len(commits) == store.control().commits and commits[max(commits)].cursor == 6
    assert read("status", state=str(min(commits))).first().status is None
    with pytest.raises(Exception, match="not kept"):
        read("status", state="99").collect()


def test_coverage_leaves_the_log_where_it_is(spark, store):
    store.put(rows(spark, 50))
    coverage = Coverage(store, 1, buckets=4)
    assert coverage.refresh() == 50 and coverage.refresh() == 0
    store.register(1, rows(spark, 5, 100).select("key"))
    assert coverage.refresh() == 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        save(rows(spark, 3, 48).unionAll(rows(spark, 10, 98)).select("key"), "live_keys", 4)
        plain = coverage.orphans(rows(spark, 3, 200).select("key"))
        bucketed = coverage.orphans(spark.table("live_keys"))
        assert plain.count() == 3 and sorted(r.key for r in bucketed.collect()) == ["k00050", "k00098", "k00099", "k00105", "k00106", "k00107"]
        count = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")
        assert count(plain) == 1 and count(bucketed) == 0
        assert coverage.contains(spark.table("live_keys")).count() == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS live_keys")
    store.reset_log(1)
    store.register(1, rows(spark, 2).select("key"))
    coverage.refresh()
    assert coverage.keys().count() == 2
    coverage.drop()


NEW = shape("Entry", 2, "amount: u32, frozen: Option<bool>")


def test_updates_between_batches(spark, store):
    store.put(rows(spark, 6))
    run = Executor(store, STEP)
    run.begin()
    run.batch(2)
    late = []

    def add(df):
        if not late:  # another writer commits while this one works
            late.append(store.put(rows(spark, 1, 5).withColumn("amount", F.lit(50).cast("bigint"))))
        return df.withColumn("amount", F.coalesce("amount", F.lit(0)) + 100).withColumn("frozen", F.coalesce("frozen", F.lit(True)))

    keys = rows(spark, 3, 4).select("key")  # two old-shaped rows, and a key without an entry
    assert store.update(NEW, keys, add, STEP) == 3
    run.run_to_completion(100)
    got = {r.key: (r.amount, r.frozen) for r in store.read(NEW).collect()}
    assert got == {**{f"k{i:05d}": (i, False) for i in range(4)}, "k00004": (104, False), "k00005": (150, False), "k00006": (100, False)}
    assert store.control().length(2) == len(store.log(2).collect()) >= 10
    refused("VersionMismatch", store.update, shape("Entry", 1, "amount: u32"), keys, add)
    with pytest.raises(Exception, match="amount is missing"):
        store.update(NEW, keys, lambda df: df.withColumn("amount", F.lit(None).cast("bigint")))
    assert store.update(NEW, keys, lambda df: df.filter("false")) == 0 and store.read(NEW).count() == 7
