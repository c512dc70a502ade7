"""The key log: an append-only table of (pos, key). It is a log, not a set: keys may repeat.

Positions are given without a global sort in one task: rows are sorted by ranges and staged, the few counts
of the ranges are summed up, and rows are numbered inside their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.functions.numbers import LARGEST_BATCH, page_of
from morphlake.sources.control import MigrationError
from morphlake.sources.files import alone


def staged(rows: DataFrame, order: list[str], path: str) -> list[tuple[int, int]]:
    """Writes rows, sorted once by ranges of the order, and says how many each part of it holds (a pair a task)."""
    with alone(rows.sparkSession):
        rows.sort(*order).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    return sorted((r[0], r[1]) for r in rows.sparkSession.read.parquet(path).groupBy(F.shiftright("__m", 33)).count().collect())


def numbered(spark: SparkSession, path: str, counts: list[tuple[int, int]], start: int = 0, name: str = "pos") -> DataFrame:
    """Staged rows numbered from start on: the parts' counts give each part's first number, its rows follow."""
    offsets = []
    for part, n in counts:
        offsets.append((part, start))
        start += n
    table = spark.createDataFrame(offsets, "__p bigint, __o bigint")
    rows = spark.read.parquet(path).withColumn("__p", F.shiftright("__m", 33).cast("bigint")).join(F.broadcast(table), "__p")  # one row a task
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, (F.col("__o") + inside).cast("bigint")).drop("__p", "__o", "__m")


def with_positions(rows: DataFrame, order: list[str], path: str, start: int = 0, name: str = "pos") -> DataFrame:
    """rows numbered by an order that tells them apart, staged at path. No range of the order is one task's alone, however
    many rows fall into it."""
    return numbered(rows.sparkSession, path, staged(rows, order, path), start, name)


def pages(log: DataFrame) -> DataFrame:
    """page, length, first_pos, last_pos of each page of the log."""
    return log.groupBy(page_of(F.col("pos")).alias("page")).agg(F.count(F.lit(1)).alias("length"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def page_keys(log: DataFrame) -> DataFrame:
    """page and its keys in order: at most a page's worth in each list."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "key")))
    return log.groupBy(page_of(F.col("pos")).alias("page")).agg(F.transform(listed, lambda x: x["key"]).alias("keys"))


def at(log: DataFrame, pos: int) -> DataFrame:
    return log.filter(F.col("pos") == pos)


def get(log: DataFrame, pos: int, length: int):
    """The key at a position below the log's length; a hole there is refused, not answered with nothing."""
    if not 0 <= pos < length:
        return None
    found = at(log, pos).select("key").take(1)
    if not found:
        raise MigrationError("CorruptIndex", f"no key at {pos} of {length}")
    return found[0][0]


def slice_of(log: DataFrame, start: int, limit: int) -> DataFrame:
    """A contiguous slice, clamped; empty past the end. A filter on pos, never an unordered limit."""
    return log.filter((F.col("pos") >= start) & (F.col("pos") < start + limit))


def reversed_slice(log: DataFrame, total: int, cursor: int, limit: int) -> DataFrame:
    """The next rows newest first: step is the position in the walk back."""
    step = F.lit(total - 1) - F.col("pos")
    return log.withColumn("step", step.cast("bigint")).filter((F.col("step") >= cursor) & (F.col("step") < cursor + limit))


def key_ranges(log: DataFrame, n: int, most: int) -> list[Column]:
    """Conditions that part n contiguous positions of a log into ranges of keys of about most rows each, so that all rows of
    a key fall under one of them. The cuts are keys of every so many positions."""
    parts = -(-n // most)
    if parts < 2:
        return [F.lit(True)]
    some = log.filter((F.col("pos") % max(n // (parts * 256), 1) == 0) & F.col("key").isNotNull())
    found = sorted(r[0] for r in some.select("key").collect())
    cuts = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
    above = [F.lit(True), *(F.col("key") >= x for x in cuts)]
    below = [*(F.col("key") < x for x in cuts), F.lit(True)]
    first, *rest = (a & b for a, b in zip(above, below))
    return [F.coalesce(first, F.lit(True)), *rest] if rest else [F.lit(True)]


def batch_of(pos: Column, size: int = LARGEST_BATCH) -> Column:
    return F.floor(pos / size).cast("bigint")


def contains(keys: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    return keys.join(log.select(key), key, "left_semi")


def orphans(keys: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """Rows of keys that the log does not know; repeated rows stay repeated."""
    return keys.join(log.select(key), key, "left_anti")


def duplicates(log: DataFrame, key: str = "key") -> DataFrame:
    """key, registrations of keys that the log holds more than once. Counts combine before the shuffle."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("registrations")).filter("registrations > 1")


def tally(visits: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """visited, migrated, already_current, skipped."""
    return visits.groupBy(*(by or [])).agg(*tallies())


def tallies() -> list[Column]:
    """The columns of tally, to aggregate or to observe."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias
    return [F.count(F.lit(1)).alias("visited"), n("Migrated")("migrated"), n("AlreadyCurrent")("already_current"), n("Skipped")("skipped")]


#: Rows that a task of dealt gets, about.
TASK_ROWS = 1 << 17


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key into so many tasks that each gets about TASK_ROWS of them, so that what a task sorts or groups does
    not grow with the table (a key's own rows stay together)."""
    return rows.repartition(-(-rows.count() // TASK_ROWS) or 1, key)


def per_visit(visits: DataFrame, key: str = "key", newest_first: bool = False) -> DataFrame:
    """Outcomes of log rows from outcomes of keys: only a key's first visit can be Migrated. The first is found as the
    least position (a log's positions differ), so rows that are sorted by key are not sorted once more."""
    first = (F.max("pos") if newest_first else F.min("pos")).over(Window.partitionBy(key))
    again = (F.col("outcome") == "Migrated") & (F.col("pos") != first)
    return visits.withColumn("outcome", F.when(again, "AlreadyCurrent").otherwise(F.col("outcome")))


def newest(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Merge on read: the newest row of each key. Maxima are combined before the shuffle."""
    rest = [c for c in entries.columns if c not in key]
    return entries.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, "__row.*")
