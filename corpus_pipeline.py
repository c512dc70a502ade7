"""A corpus pipeline: five stages, each a whole pass over what the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Null and empty texts pass every filter (they are neither toxic nor copies
nor contaminated) and end with no ids. Extra columns pass through. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm import decontaminate, linededup, ngramjoin, spm, toxicity
from morphlake.llm.common import dropped, fresh, in_bucket, stored, table

#: Near-duplicates share word 5-grams at this similarity, in percent.
WIDTH, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the network scores at the threshold or above."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~in_bucket("doc_id", 4, 2)))
    (score,) = fresh(docs, "__score")
    return toxicity.score_documents(docs, net, name=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of lines that stand earlier; n_chars follows. A document goes only
    if all its lines do."""
    lines, removed = fresh(docs, "__n_lines", "__n_removed")
    cut = linededup.dedup_lines(docs, n_lines=lines, n_removed=removed).filter((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    changed = F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of linked documents; null ids come last, and of several texts of
    that id the one of the least hash stays. Each text of a repeated or null id is a document of its own. Rows that
    repeat an id and a text are one. Documents with no words are in no class and stay."""
    linked = ngramjoin.link_documents(docs, width=WIDTH, percent=PERCENT)
    own, text, hashed = fresh(docs, "__kept", "__text", "__hash")
    one = F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "__hash")).alias("first")
    first = linked.filter("__class is not null").groupBy("__class").agg(one).select("first.__id", "first.__hash")
    first = first.unionAll(linked.filter("__class is null").select("__id", "__hash").distinct())
    marked = docs.withColumn(text, F.xxhash64("text"))
    kept = marked.join(first.toDF(own, hashed), F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(text) == F.col(hashed)), "left_semi")
    return kept.dropDuplicates(["doc_id", text]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each text."""
    (ids,) = fresh(docs, "__ids")
    out = spm.encode_documents(docs, ids=ids)
    return out.select("doc_id", "lang", "source", F.col(ids).alias("ids"), F.size(ids).cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Neither the network nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)  # its successor is stored
        before = docs
    return docs
