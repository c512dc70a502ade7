"""Questions about recorded versions, asked of tables: (name, version), one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.numbers import suffix_stem


def pairs(versions: DataFrame) -> DataFrame:
    """name, version, next_version: neighbouring recorded versions, gaps included."""
    after = F.lead("version").over(Window.partitionBy("name").orderBy("version"))
    return versions.select("name", "version").distinct().withColumn("next_version", after).filter("next_version IS NOT NULL")


def gaps(versions: DataFrame) -> DataFrame:
    return pairs(versions).filter("next_version <> version + 1")


def summary(versions: DataFrame) -> DataFrame:
    """name, latest, next_version, contiguous."""
    first, last = F.min("version"), F.max("version")
    return versions.groupBy("name").agg(last.alias("latest"), (last + 1).cast("int").alias("next_version"), (last - first + 1 == F.count_distinct("version")).alias("contiguous"))


def families(names: DataFrame) -> DataFrame:
    """stem, members (sorted): names that differ by a version suffix only, where there are several."""
    stems = names.select("name", suffix_stem(F.col("name")).alias("stem")).filter("stem IS NOT NULL")
    return stems.groupBy("stem").agg(F.sort_array(F.collect_set("name")).alias("members")).filter("size(members) >= 2")


def gates(pairs_: DataFrame) -> DataFrame:
    """recorded, expected, gate, behind: what a reader that expects a version meets."""
    r, e = F.col("recorded"), F.col("expected")
    gate = F.when(r.isNull(), "NotInitialized").when(r > e, "StateNewerThanContract").when(r < e, "VersionMismatch").otherwise("ok")
    return pairs_.select("recorded", "expected", gate.alias("gate"), F.coalesce(r < e, F.lit(False)).alias("behind"))
