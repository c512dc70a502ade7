"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask of ones and zeros laid over a run of words hashes the words under the ones and ignores
the others, so a substituted word under a zero leaves the hash alone. Seeds of the benchmark
items and of the documents are joined; a shared seed puts an item on a diagonal of a document
(document position less item position). Around each hit, the item is laid on its diagonal and
its words compared: a window of OVERLAP words (the whole item, if that is shorter) with at most
SUBSTITUTIONS unlike words (in proportion, if shorter) is an overlap. The masks are chosen so that
every such window holds a seed, wherever its unlike words stand: no overlap is missed.

Words are runs of characters other than white space, in lower case. Defined cases: null and
empty texts have no words and match nothing; items of few words are compared whole, those under
five exactly. Rows that repeat an id are each looked at; the result has a row per pair of ids.
Null ids are kept apart from others by the text. Extra columns of documents are ignored by
`overlaps` and pass through `clean`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import fresh, stored

OVERLAP, SUBSTITUTIONS = 13, 3
#: Words that each mask looks at, as distances from the first. Every window of 7 to OVERLAP words
#: with the unlike words that are allowed has a place for one of them (a test goes through all).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 6), (0, 1, 2, 4, 5), (0, 2, 3, 4, 5), (0, 1, 4, 6, 7))
#: Items of fewer words than this have masks of their own, by their length.
SPAN = 7
SHORT = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),),
    5: ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4)), 6: ((0, 1, 2, 3), (0, 1, 3, 4)),
}
#: Seeds of the benchmark, or documents hit, up to which they are broadcast (about 40 bytes each); beyond it, both sides are shuffled.
BROADCAST_ROWS = 500_000


#: What Java's \\s matches.
WHITE = " \t\n\r\f\x0b"


def _words(text_col: str):
    return F.split(F.lower(F.trim(F.col(text_col), F.lit(WHITE))), r"\s+", -1)


def _once(df: DataFrame, keep: list, value, name: str) -> DataFrame:
    """Adds a value that the optimizer can't copy into the expressions that use it."""
    return df.select(*keep, F.inline(F.array(F.struct(value.alias(name)))))


def _split(df: DataFrame, key: list, text_col: str) -> DataFrame:
    return _once(df, key, _words(text_col), "__w").filter("size(__w) > 1 OR __w[0] <> ''")


def _seeds(split: DataFrame, keys: list[str], pos: str, masks: list[tuple]) -> DataFrame:
    """A row for each mask at each position: __seed and its position.

    Both generators are compiled with the projection and the probe that follow, so a position
    costs a few hashes and the words are never copied.
    """
    least = min(mask[-1] for mask in masks)
    at = split.filter(F.size("__w") > least).select(*keys, "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - least - 1)).alias(pos))
    seed = lambda mask: F.xxhash64(*[F.get(F.col("__w"), F.col(pos) + k) for k in mask], F.lit(sum(1 << k for k in mask)))
    seeds = [F.when(F.col(pos) + mask[-1] < F.size("__w"), seed(mask)) if mask[-1] > least else seed(mask) for mask in masks]
    return at.select(*keys, pos, F.explode(F.array(*seeds)).alias("__seed")).filter("__seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that overlap: __id, __item, where the best window
    starts in the document (in words), how many of its words agree, and its length."""
    spark = docs.sparkSession
    items = _split(benchmark, [F.col(item_col).alias("__item"), F.xxhash64(item_col, item_text).alias("__ikey")], item_text)
    short = sorted(n for (n,) in items.select(F.size("__w")).filter(F.size("__w") < SPAN).distinct().collect())  # under SPAN rows
    item_seeds = _seeds(items.filter(F.size("__w") >= SPAN), ["__ikey"], "__ipos", list(MASKS))
    masks = list(MASKS)
    for n in short:
        item_seeds = item_seeds.unionAll(_seeds(items.filter(F.size("__w") == n), ["__ikey"], "__ipos", list(SHORT[n])))
        masks += [m for m in SHORT[n] if m not in masks]
    item_seeds = item_seeds.distinct()
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    doc_seeds = _seeds(_split(keyed, ["__id", "__key"], "__text"), ["__id", "__key"], "__pos", masks)
    small = item_seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = doc_seeds.join(F.broadcast(item_seeds) if small else item_seeds, "__seed")
    found = stored(spark, hits.select("__id", "__key", "__ikey", (F.col("__pos") - F.col("__ipos")).alias("__diagonal")).distinct(), "found")
    item_words = items.select("__ikey", "__item", F.col("__w").alias("__iw")).distinct()
    laid = found.join(F.broadcast(item_words) if small else item_words, "__ikey")
    # Only documents that are hit are sent and laid beside their items, each once.
    hit = found.select(F.col("__id").alias("__hid"), F.col("__key").alias("__hkey")).distinct()
    few = hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same_row = (F.col("__key") == F.col("__hkey")) & F.col("__id").eqNullSafe(F.col("__hid"))
    own = keyed.join(F.broadcast(hit) if few else hit, same_row, "left_semi").dropDuplicates(["__id", "__key"])
    doc_words = _split(own, [F.col("__id").alias("__hid"), F.col("__key").alias("__hkey")], "__text")
    both = laid.join(doc_words, same_row).withColumn("__n", F.least(F.lit(OVERLAP), F.size("__iw")))
    same = F.expr("transform(__iw, (w, i) -> if(__diagonal + i >= 0 and get(__w, greatest(__diagonal + i, 0)) <=> w, 1, 0))")
    sums = F.expr("array_max(transform(sequence(0, size(__same) - __n), i -> struct(aggregate(slice(__same, i + 1, __n), 0, (a, x) -> a + x) as agree, -i as before)))")
    compared = _once(both, ["__id", "__item", "__diagonal", "__n"], same, "__same")
    best = _once(compared, ["__id", "__item", "__diagonal", "__n"], sums, "__best")
    enough = F.col("__best.agree") >= F.col("__n") - F.floor(F.col("__n") * SUBSTITUTIONS / OVERLAP)
    rows = best.filter(enough).select("__id", "__item", F.struct(F.col("__best.agree").alias("agree"), (-(F.col("__diagonal") - F.col("__best.before"))).alias("before"), F.col("__n").alias("n")).alias("__s"))
    top = rows.groupBy("__id", "__item").agg(F.max("__s").alias("__s"))
    return top.select("__id", "__item", (-F.col("__s.before")).alias("__start"), F.col("__s.agree").alias("__agree"), F.col("__s.n").alias("__window"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that overlap no item."""
    (own,) = fresh(docs, "__found")
    found = overlaps(docs, benchmark, id_col, text_col).select(F.col("__id").alias(own)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = overlaps(docs, bench)
    return out.select(F.col("__id").alias("doc_id"), F.col("__item").alias("item_id"), *[F.col(f"__{c}").cast("long").alias(f"{c}_words" if c != "start" else "start_word") for c in ("start", "agree", "window")])


ORACLE = rf"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)
), bw AS (
  SELECT item_id, len(w) AS n_item, unnest(w) AS word, unnest(range(0, len(w))) AS pos
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark)
), dl AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER d AS w1, lead(word, 2) OVER d AS w2 FROM dw WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), bl AS (
  SELECT item_id, n_item, pos, word, lead(word, 1) OVER b AS w1, lead(word, 2) OVER b AS w2 FROM bw WINDOW b AS (PARTITION BY item_id ORDER BY pos)
), hits AS (
  -- no masks: a window of 7 to 13 words with so few unlike ones has three equal words in a row
  SELECT d.doc_id, b.item_id, d.pos - b.pos AS diagonal FROM dl d JOIN bl b ON d.word = b.word AND d.w1 = b.w1 AND d.w2 = b.w2 WHERE b.n_item >= 7
  UNION SELECT d.doc_id, b.item_id, d.pos - b.pos FROM dl d JOIN bl b ON d.word = b.word WHERE b.n_item < 7
), laid AS (
  SELECT h.doc_id, h.item_id, h.diagonal, b.pos, b.n_item, least({OVERLAP}, b.n_item) AS n,
    CASE WHEN d.word = b.word THEN 1 ELSE 0 END AS same
  FROM hits h JOIN bw b ON h.item_id = b.item_id
  LEFT JOIN dw d ON d.doc_id = h.doc_id AND d.pos = h.diagonal + b.pos
), summed AS (
  SELECT doc_id, item_id, diagonal, pos, n, n_item, sum(same) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos ROWS BETWEEN CURRENT ROW AND {OVERLAP - 1} FOLLOWING) AS agree
  FROM laid
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, diagonal + pos) AS r
  FROM summed WHERE pos + n <= n_item AND agree >= n - floor(n * {SUBSTITUTIONS} / {OVERLAP})
)
SELECT doc_id, item_id, CAST(diagonal + pos AS BIGINT) AS start_word, CAST(agree AS BIGINT) AS agree_words, CAST(n AS BIGINT) AS window_words
FROM best WHERE r = 1
"""
