"""A migration as a stream: newly landed entries are taken in, and batches run until the log is
used up.

The stream's checkpoint says which files were taken in. The number of a batch is kept in the same
commit as its rows, so a batch that is given twice is seen and left out, and each entry is put
once. Rows that land when the step is complete are put through it on their way in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from morphlake.functions.numbers import LARGEST_BATCH
from morphlake.operators.executor import Executor
from morphlake.operators.log import newest
from morphlake.sources.control import COMPLETED
from morphlake.sources.store import Store


def ingest(spark: SparkSession, landing: str, schema: str, store: Store, checkpoint: str, executor: Executor | None = None, limit: int = LARGEST_BATCH, name: str = "landing") -> StreamingQuery:
    """Puts all entries that have landed, then migrates as far as the log goes. Ends by itself.

    name tells the streams of a store apart: it belongs to the checkpoint.
    """

    def take(batch: DataFrame, number: int) -> None:
        c = store.control()
        complete = executor is not None and c.version is not None and c.version >= executor.b
        if complete:
            batch = executor.step.up(batch).drop("outcome")
        store.put(batch, stream=(name, number))
        if executor is None or complete:
            return
        if not (c.migration and c.migration.is_for(executor.a, executor.b) and c.migration.status == COMPLETED):
            executor.begin()
            while not executor.batch(limit).done:
                pass

    source = spark.readStream.schema(schema).parquet(landing)
    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """The sum and the number of each key's values: of all rows of a table, or of a stream so far."""
    return events.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def follow_totals(spark: SparkSession, landing: str, schema: str, key: str, value: str, checkpoint: str, out: str) -> StreamingQuery:
    """Takes in what has landed and writes the totals of the keys that it moved, as they are then: a folder a
    micro-batch below out. The sums so far are the stream's state, which stands in the checkpoint and outlives
    restarts; only sums are kept, combined before the shuffle, so a hot key is one small row. Ends by itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is given twice replaces itself

    source = spark.readStream.schema(schema).parquet(landing)
    totals = running_totals(source, key, value)
    return totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The last totals of each key from what follow_totals has written."""
    rows = spark.read.parquet(out)
    return newest(rows, [c for c in rows.columns if c not in ("total", "n", "batch")], ["batch"]).drop("batch")


def totals_state(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """key, total and n from the state in a stream's checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col(f"key.{key}").alias(key), F.col("value.sum").alias("total"), F.col("value.count").alias("n"))
