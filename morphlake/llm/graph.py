"""Connected components over tables, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import dropped, stored


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, comp) for each node of an edge; comp is the least node reachable.

    Rounds of large star and small star: a node's larger neighbours are hung on the least
    neighbour, then its smaller ones. Minima are combined before the shuffle, so a node with
    very many neighbours is a join that can be split by size, never a list. Each round is
    stored in the shared folder. An empty table of edges gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(u, v).alias("x"), F.least(u, v).alias("y")).filter("x <> y").distinct()
    now = stored(spark, now, "edges")
    while True:
        both = now.select(F.col("x").alias("s"), F.col("y").alias("t")).unionAll(now.select(F.col("y").alias("s"), F.col("x").alias("t")))
        least = both.groupBy("s").agg(F.least(F.min("t"), F.first("s")).alias("m"))
        large = both.filter("t > s").join(least, "s").select(F.col("t").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        # large holds for each x a smaller y: the small star hangs x and its ys on the least of them.
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        small = small.select(F.col("y").alias("x"), F.col("m").alias("y")).unionAll(low.select("x", F.col("m").alias("y")))
        after = stored(spark, small.filter("x <> y").distinct(), "edges")
        # Done when every node hangs on one root and no root hangs on another.
        bad = after.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        bad = bad or after.select("x").join(after.select(F.col("y").alias("x")), "x", "left_semi").limit(1).count()
        dropped(now)
        now = after
        if not bad:
            break
    return now.select(F.col("x").alias("node"), F.col("y").alias("comp")).unionAll(now.select(F.col("y").alias("node"), F.col("y").alias("comp")).distinct())
