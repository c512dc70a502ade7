"""Line deduplication by overlapping three-line windows, with DataFrame functions only.

Every run of three consecutive lines is hashed. Over all documents, the first occurrence of
a window (least id, then position) stays; every later one covers its three lines. Covered
positions are merged and taken out. Each line removed still stands somewhere earlier.

Defined cases: a null or empty text, or one with fewer than three lines, has no windows and
stays as it is. Windows of white space alone count as nothing. Rows that repeat an id and a
text count as one occurrence. A null id comes before all others. Extra columns pass through,
whatever their names; one with the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import fresh, stored

WINDOW = 3
#: A character that is not blank.
FILLED = r"[^ \t\n\r\x0B\f]"


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.split(F.col(text_col), "\n", -1)
    at = lambda i, k: F.get(F.col("__lines"), i + k)
    window = lambda i: F.struct(
        i.alias("__pos"),
        F.xxhash64(*[at(i, k) for k in range(WINDOW)]).alias("__h"),
        F.hash(*[at(i, k) for k in reversed(range(WINDOW))]).alias("__g"),
        F.concat(*[at(i, k) for k in range(WINDOW)]).rlike(FILLED).alias("__full"),
    )
    return (
        docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__key"), lines.alias("__lines"))
        .filter(F.size("__lines") >= WINDOW)
        .select("__id", "__key", F.inline(F.transform(F.sequence(F.lit(0), F.size("__lines") - WINDOW), window)))
        .filter("__full")
        .drop("__full")
    )


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__key, __pos) of each window whose content stands earlier in the corpus."""
    windows = _windows(docs, id_col, text_col)
    place = F.struct("__id", "__key", "__pos")
    # Counts and minima are combined before the shuffle.
    first = windows.groupBy("__h", "__g").agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__first")).filter("__n > 1")
    # Stored, so that the join deals both sides anew and a common window's rows can be split.
    first = stored(docs.sparkSession, first.drop("__n"), "first")
    return windows.join(first, ["__h", "__g"]).filter(~place.eqNullSafe(F.col("__first"))).select("__key", "__pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "__n_lines", n_removed: str = "__n_removed") -> DataFrame:
    """docs with the text cut, and n_lines, n_removed beside the other columns."""
    docs = docs.drop(n_lines, n_removed)
    key, starts_, lines_, kept_ = fresh(docs, "__key", "__starts", "__lines", "__kept")
    covered = later_windows(docs, id_col, text_col).groupBy(F.col("__key").alias(key)).agg(F.sort_array(F.collect_set("__pos")).alias(starts_))
    lines, starts = F.split(F.col(text_col), "\n", -1), F.col(starts_)
    # The runs of lines kept: from the end of one window to the start of the next.
    runs = F.transform(
        F.sequence(F.lit(0), F.size(starts)),
        lambda i: F.struct(
            F.coalesce(F.get(starts, i - 1) + WINDOW, F.lit(0)).alias("a"),
            F.coalesce(F.get(starts, i), F.size(lines_)).alias("b"),
        ),
    )
    kept = F.flatten(F.transform(F.filter(runs, lambda r: r.b > r.a), lambda r: F.slice(F.col(lines_), r.a + 1, r.b - r.a)))
    joined = docs.withColumn(key, F.xxhash64(id_col, text_col)).join(covered, key, "left").withColumn(lines_, lines)
    return (
        joined.withColumn(kept_, F.when(starts.isNull(), F.col(lines_)).otherwise(kept))
        .withColumn(text_col, F.when(starts.isNull(), F.col(text_col)).otherwise(F.array_join(kept_, "\n")))
        .withColumn(n_lines, F.coalesce(F.size(lines_), F.lit(0)))
        .withColumn(n_removed, F.when(starts.isNull(), 0).otherwise(F.size(lines_) - F.size(kept_)))
        .drop(key, starts_, lines_, kept_)
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "text", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r
  FROM windows WHERE regexp_matches(w, '[^ \t\n\r\v\f]')
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest(range(0, 3)) AS k) WHERE r > 1
), each_line AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM lines
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text, count(*) AS n
  FROM each_line e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(k.text, '') AS text, CAST(len(d.l) AS BIGINT) AS n_lines,
  CAST(len(d.l) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM lines d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
