"""Many small batches by one job: the same outcomes as one after another, and work that does not grow with their number."""

import os

import pytest
from morphlake import queries
from morphlake.operators import executor
from morphlake.operators.executor import Executor
from morphlake.operators.log import key_ranges
from morphlake.operators.replay import Forked, replay
from morphlake.plans.compile import compile_step
from morphlake.plans.diff import diff
from morphlake.plans.model import Plan, shape
from morphlake.queries import QUERIES
from morphlake.sources.store import Store
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
STEP = compile_step(diff(shape("Entry", 1, "amount: u32"), shape("Entry", 2, "amount: u32, frozen: Option<bool>"), Plan(1, 2, {"frozen": "false"})))


def filled(spark, root):
    """A log with keys that come again, one that has no entry, and one that is current."""
    store = Store(spark, root)
    store.initialize(1)
    keys = lambda ids: spark.createDataFrame([(f"k{i:03d}",) for i in ids], "key string")
    store.put(spark.range(10).select(F.format_string("k%03d", "id").alias("key"), "id", F.when(F.col("id") == 4, True).alias("frozen")))
    store.register(1, keys([3, 3, 99, 7]))
    return store


def test_batches_together(spark, tmp_path):
    alone, together = filled(spark, tmp_path / "a"), filled(spark, tmp_path / "b")
    runs = [Executor(s, STEP) for s in (alone, together)]
    for run in runs:
        run.begin()
    first = runs[0].run_to_completion(4)
    before = together.control().commits
    got = runs[1].run_to_completion(4, together=100)
    assert got == first and [o.visited for o in got] == [4, 4, 4, 2] and sum(o.skipped for o in got) == 1
    assert together.control().commits == before + 1
    rows = lambda s: sorted((r.key, r.id, r.frozen) for r in s.entries().collect())
    log = lambda s, v: sorted((r.pos, r.key) for r in s.log(v).collect())
    assert rows(alone) == rows(together) and log(alone, 2) == log(together, 2)
    for run in runs:
        run.begin_rollback()
    back = runs[1].rollback_to_completion(4, together=3)  # the last of them by a second job
    assert back == runs[0].rollback_to_completion(4) and len(back) == 4
    assert rows(alone) == rows(together) and log(alone, 1) == log(together, 1)


def test_dry_run_together(spark, tmp_path):
    store = filled(spark, tmp_path / "a")
    make = lambda s: Executor(s, STEP)
    one, all_ = (replay(Forked(store, make, tmp_path / x, n), 4) for x, n in (("one", 1), ("all", 100)))
    assert [o for o, _ in one.batches] == [o for o, _ in all_.batches] and all_.completed
    assert [c["rows"] for _, c in all_.batches] == [4, 4, 4, 2] and all(c["seconds"] > 0 for _, c in all_.batches)
    assert store.control().version == 1


@pytest.mark.parametrize("name, batches", [("batched_migration", 7), ("dry_run_accounts", 4)])
def test_small_batches_take_one_job(spark, monkeypatch, name, batches):
    """The number of batches grows with the documents, that of the jobs does not."""
    kinds, write = [], Store.write
    monkeypatch.setattr(Store, "write", lambda self, df, kind: kinds.append(kind) or write(self, df, kind))
    assert QUERIES[name](spark, SF).count() == batches and kinds.count("visits") == 1


def test_a_delta_of_all_rows_takes_the_place_of_the_folder(spark, tmp_path):
    """So what a later step reads does not grow with the steps. One that leaves a row out stays beside it."""
    for extra, folders in (((), 1), (("old",), 2)):
        store = Store(spark, tmp_path / f"s{folders}")
        store.initialize(1)
        store.put(spark.range(9).select(F.format_string("k%03d", "id").alias("key"), "id"))
        if extra:
            store.put(spark.createDataFrame([(x, 1, True) for x in extra], "key string, id bigint, frozen boolean"))
            store.compact()
        before = store.control()
        run = Executor(store, STEP)
        run.begin()
        assert run.run_to_completion(4, together=10)[-1].done
        assert len(store.control().entries) == folders and store.entries().count() == 9 + len(extra)
        assert store.entries(before).count() == 9 + len(extra) and {r.frozen for r in store.entries().collect()} <= {False, True}


def test_steps_one_after_another_read_one_folder(spark, monkeypatch):
    read, merged = [], Store._merged
    monkeypatch.setattr(Store, "_merged", lambda self, c, folders, *a, **k: read.append(len(folders)) or merged(self, c, folders, *a, **k))
    QUERIES["chained_rollback"](spark, "/root/testdata/sf0.001")
    assert max(read) == 1


def test_a_large_slice_goes_by_ranges_of_keys(spark, tmp_path, monkeypatch):
    """The same rows, logs and outcomes, and the visits of one range on disk at a time."""
    alone, ranges = filled(spark, tmp_path / "a"), filled(spark, tmp_path / "b")
    runs = [Executor(s, STEP) for s in (alone, ranges)]
    rows = lambda s: sorted((r.key, r.id, r.frozen) for r in s.entries().collect())
    log = lambda s, v: sorted((r.pos, r.key) for r in s.log(v).collect())
    most, write = [], Store.write
    monkeypatch.setattr(Store, "write", lambda self, df, kind: (write(self, df, kind), most.append(len(os.listdir(f"{self.root}/visits")) if kind == "visits" else 0))[0])
    for run, size in zip(runs, (100, 3)):
        monkeypatch.setattr(executor, "AT_ONCE", size)
        most.clear()
        run.begin()
        run.outcomes = run.run_to_completion(4, together=100)
        run.begin_rollback()
        run.forth = rows(run.store), log(run.store, 2)
        run.outcomes += run.rollback_to_completion(4, together=3)
    assert runs[0].outcomes == runs[1].outcomes and runs[0].forth == runs[1].forth
    assert rows(alone) == rows(ranges) and log(alone, 1) == log(ranges, 1)
    assert len([x for x in most if x]) > 6 and max(most) <= 3  # a slice leaves one of its visits


def test_each_row_falls_into_one_range(spark):
    key = F.when(F.col("pos") == 5, F.lit(None)).when(F.col("pos") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("\u00e9"), F.hash("pos").cast("string")))
    log = spark.range(900).withColumnRenamed("id", "pos").withColumn("key", key)
    conditions = key_ranges(log, 900, 100)
    sizes = [log.filter(x).count() for x in conditions]
    assert sum(sizes) == 900 and len(conditions) > 5 and sorted(sizes)[-2] < 200
    assert log.select(sum(F.coalesce(x, F.lit(False)).cast("int") for x in conditions).alias("n")).distinct().collect() == [(1,)]
    assert len(key_ranges(log.filter("key = 'hot'"), 900, 100)) < 3 and len(key_ranges(log.filter("false"), 900, 100)) == 1


def test_what_no_state_reads_does_not_stay_on_disk(spark, tmp_path, monkeypatch):
    """Chained steps: two folders of entries at most, one log for all versions, and no shuffle files of jobs that have ended."""
    root, most, write = str(tmp_path / "store"), [], Store.write
    monkeypatch.setattr(queries, "scratch", lambda spark: root)
    monkeypatch.setattr(Store, "write", lambda self, df, kind: (write(self, df, kind), most.append(len(os.listdir(f"{root}/entries")) if kind == "entries" else 0))[0])
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in (files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())) if x.startswith("shuffle_")}
    before, n = shuffled(), spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().count()
    assert QUERIES["chained_rollback"](spark, "/root/testdata/sf0.001").count() == n
    left = {x.split("_")[1] for x in shuffled() - before}
    assert max(most) == 2 and len(left) < 8  # small counts only, until the driver collects its garbage
    assert [len(os.listdir(f"{root}/{x}")) for x in ("entries", "log", "visits", "staged")] == [2, 1, 0, 0]


def test_versions_share_a_log_until_one_grows(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    store.initialize(1)
    store.put(spark.range(9).select(F.format_string("k%03d", "id").alias("key"), "id"))
    run = Executor(store, STEP)
    run.begin()
    run.run_to_completion(100)
    assert store.control().log(1) == store.control().log(2)
    store.register(2, spark.createDataFrame([("late",)], "key string"))
    assert store.log(1).count() == 9 and store.log(2).count() == 10 == store.control().length(2)
    run.begin_rollback()
    c = store.control()
    assert not c.log(1) and all(x in c.sizes for x in c.log(2)) and store.log(2, start=9, limit=1).first().key == "late"
    assert run.rollback_to_completion(100)[-1].done and store.log(1).count() == 10


def test_growth_of_more_than_a_million_keys_is_one_batch(spark, tmp_path):
    n = 1_060_000
    day = F.expr("timestamp'2024-01-05 00:00:00' + make_interval(0, 0, 0, if(id < 10, 0, 10))")
    spark.range(n).select(F.col("id").alias("event_id"), day.alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["growth_absorbed"](spark, str(tmp_path)).orderBy("batch").collect()
    assert [(r.cursor, r.total, r.visited, r.migrated, r.done) for r in rows] == [(10, n, 10, 10, False), (n, n, n - 10, n - 10, True)]
