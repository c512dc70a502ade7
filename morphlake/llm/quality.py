"""Quality rules: counts of repetition and symbols, and the distance of a document from its language.

A document is described by two histograms: of the classes of its characters, and of its words over the common
words of its language (and all others). Each is compared with the language's own by the Jensen-Shannon
distance (base 2, from 0 to 1). The languages' references come from all documents: the common words are the 50
most frequent ones (A-Z lowered, ties by text) with their counts over all documents; the classes' reference is the
median of each class's share, in thousandths, over the documents that pass the base rules, so that junk does not
move it. A language counts as one from 20 documents and a thousandth of all on; the documents of
all others and those without a language share one reference.

Short texts scatter more, so the words' limit falls with the number of words n, as WORDS_LIMIT + WORDS_SLOPE / sqrt(n);
texts below the base's 50 words are dropped by the base, whatever their distances.

Defined cases: null and empty texts have no words and are dropped by the base; rows that repeat an id are each
judged; an empty table gives no rows. Words are told apart by 64-bit hashes within batches. Extra columns pass
through; one with the name of a result gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm.common import U, _LOWER, bounded_batches, buffer_of, mix, shingle_hashes, slices, span_hashes, stored_alone, table, word_spans

#: Base rules: least number of words, most percent of words in repeated windows, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Common words of a language; least documents of one, and least share of all documents as 1 / SHARE.
COMMON, LEAST_DOCS, SHARE = 50, 20, 1000
#: Largest distance of the characters; of the words, for n of them, WORDS_LIMIT + WORDS_SLOPE / sqrt(n).
CHARS_LIMIT, WORDS_LIMIT, WORDS_SLOPE = 0.2, 0.2, 1.8
#: The classes of characters. What is in none of them is other ASCII, or beyond ASCII.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "white": r"\x20\x09-\x0D", "stop": ".,;:!?", "symbol": "#*$%&|<>"}
_NAMES = [*CLASSES, "other", "beyond"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _class_table() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)
    out[0x80:0xC0] = -1  # the rest of a character
    out[0xC0:] = len(CLASSES) + 1
    for i, (a, z) in enumerate([("a", "z"), ("A", "Z"), ("0", "9")]):
        out[ord(a) : ord(z) + 1] = i
    out[[0x20, *range(0x09, 0x0E)]] = 3
    for i, name in ((4, "stop"), (5, "symbol")):
        out[[ord(c) for c in CLASSES[name]]] = i
    return out


_CLASS = _class_table()


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, groups: list[str], common: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The counts of each text, its characters by class, and its words by the common words of its group."""
    raw, offsets = buffer_of(texts)
    n = len(texts)
    starts, ends, splits = word_spans(raw, offsets)
    kind = _CLASS[raw]
    of = np.repeat(np.arange(n), np.diff(offsets))
    chars = np.bincount((of * (len(_NAMES) + 1) + kind + 1), minlength=n * (len(_NAMES) + 1)).reshape(n, -1)[:, 1:]
    words = np.diff(splits)
    # a word is repeated if any window over it stands twice in its text
    made, cuts = shingle_hashes(span_hashes(raw, starts, ends), splits, WINDOW)
    with np.errstate(over="ignore"):
        keys = mix(made + np.repeat(np.arange(1, n + 1, dtype=U), np.diff(cuts)) * U(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    equal = np.zeros(len(keys) + 1, bool)
    equal[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order] = equal[:-1] | equal[1:]
    text_of = np.repeat(np.arange(n), np.diff(cuts))
    at = (np.arange(len(keys)) - cuts[:-1][text_of] + splits[:-1][text_of])[twice & (words[text_of] >= WINDOW)]
    change = np.bincount(at, minlength=len(starts) + WINDOW + 1) - np.bincount(at + WINDOW, minlength=len(starts) + WINDOW + 1)
    covered = np.cumsum(change)[: len(starts)] > 0
    word_of = np.repeat(np.arange(n), words)
    lowered = span_hashes(_LOWER[raw], starts, ends)
    hist = np.zeros((n, COMMON + 1), np.int64)
    for g in set(groups):
        mine = np.array([x == g for x in groups])
        known = common.get(g, np.zeros(0, U))
        sort = np.argsort(known)
        w = np.flatnonzero(mine[word_of])
        place = np.searchsorted(known[sort], lowered[w])
        hit = np.zeros(len(w), bool)
        inside = place < len(known)
        hit[inside] = known[sort][place[inside]] == lowered[w][inside]
        slot = np.where(hit, sort[np.minimum(place, len(known) - 1)] if len(known) else 0, COMMON)
        hist += np.bincount(word_of[w] * (COMMON + 1) + slot, minlength=n * (COMMON + 1)).reshape(n, -1)
    return {
        "n_words": words, "word_chars": chars.sum(1) - chars[:, 3], "n_symbols": chars[:, 5], "n_dup_lines": np.array([repeated_lines(t) for t in texts.to_pylist()], np.int64),
        "n_repeat_words": np.bincount(word_of[covered], minlength=n), "chars": chars, "words": hist,
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _group(docs: DataFrame, lang_col: str) -> Column:
    """The language, or an empty text for those that are too rare to have a reference of their own."""
    n = docs.count()
    often = docs.groupBy(lang_col).count().filter((F.col("count") >= LEAST_DOCS) & (F.col("count") * SHARE >= n) & F.col(lang_col).isNotNull())
    names = [r[0] for r in often.collect()]  # at most SHARE
    return F.when(F.col(lang_col).isin(names), F.col(lang_col).cast("string")).otherwise(F.lit("")) if names else F.lit("")


def common_words(docs: DataFrame, group: Column, text_col: str) -> DataFrame:
    """grp, place, word, n: the most frequent words of each group over all documents."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(group.alias("grp"), F.explode(F.split(lowered, r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    order = Window.partitionBy("grp").orderBy(F.desc("n"), "word")
    return words.groupBy("grp", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= COMMON).withColumn("place", F.col("place") - 1)


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of counts; 1 if one of them is all zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    tp, tq = total(p), total(q)
    term = F.zip_with(p, q, lambda a, b: part(a / tp, (a / tp + b / tq) / 2) + part(b / tq, (a / tp + b / tq) / 2))
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(total(term) / 2, F.lit(0.0)))).otherwise(1.0)


def assess(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns named by keep (all of docs, if None) that no result clashes with, the counts, chars_distance,
    words_distance, base_failed and kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    group = _group(docs, lang_col)
    top: dict[str, list[tuple[int, str, int]]] = {}
    for r in common_words(docs, group, text_col).collect():  # at most COMMON for each of at most SHARE languages
        top.setdefault(r.grp, []).append((r.place, r.word, r.n))
    known = {}
    for g, rows in top.items():
        texts = [w.encode() for _, w, _ in sorted(rows)]
        ends = np.cumsum([len(w) for w in texts])
        known[g] = span_hashes(np.frombuffer(b"".join(texts), np.uint8), ends - [len(w) for w in texts], ends)
    made = [*COUNTS, "base_failed", "kept", "chars_distance", "words_distance"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    asked = docs.select(*kept, group.alias("__group"), F.col(text_col).alias("__text"))
    counts = [T.StructField(c, T.LongType()) for c in COUNTS]
    schema = T.StructType([*asked.drop("__text").schema, *counts, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("__chars", "__words"))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "__text"):
                m = measure(b.column("__text"), b.column("__group").to_pylist(), known)
                hist = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * m[c].shape[1], pa.int32()), pa.array(m[c].ravel())) for c in ("chars", "words")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*kept, "__group")), *(pa.array(m[c]) for c in COUNTS), *hist], schema.names)

    rows = stored_alone(spark, asked.mapInArrow(measured, schema).withColumn("base_failed", base_failed()), "measured")
    return _judged(rows, top).select(*kept, *made)


def _judged(rows: DataFrame, top: dict[str, list[tuple[int, str, int]]]) -> DataFrame:
    spark = rows.sparkSession
    sums = {r["__group"]: r.n for r in rows.groupBy("__group").agg(F.sum("n_words").alias("n")).collect()}  # a row a language
    share = F.posexplode(F.transform("__chars", lambda c: F.floor(1000 * c / F.col("__total"))))
    total = rows.filter("NOT base_failed").withColumn("__total", F.aggregate("__chars", F.lit(0).cast("bigint"), lambda a, b: a + b))
    counts = total.select("__group", share.alias("class", "share")).groupBy("__group", "class", "share").count()
    span = Window.partitionBy("__group", "class")  # at most 1001 values
    median = counts.withColumn("below", F.sum("count").over(span.orderBy("share"))).withColumn("all", F.sum("count").over(span)).filter("2 * below >= all").groupBy("__group", "class").agg(F.min("share").alias("m"))
    classes: dict[str, list[float]] = {}
    for r in median.collect():  # a row a language and class
        classes.setdefault(r["__group"], [0.5] * len(_NAMES))[r["class"]] = r.m + 0.5
    reference = [(g, classes.get(g, [0.5] * len(_NAMES)), [float(x) for x in _histogram(top.get(g, []), n)]) for g, n in sums.items()]
    refs = spark.createDataFrame(reference, "__group string, __rc array<double>, __rw array<double>")
    doubles = lambda c: F.col(c).cast("array<double>")
    out = rows.join(F.broadcast(refs), "__group")  # at most SHARE rows
    out = out.withColumn("chars_distance", distance(doubles("__chars"), F.col("__rc"))).withColumn("words_distance", distance(doubles("__words"), F.col("__rw")))
    near = (F.col("chars_distance") <= CHARS_LIMIT) & (F.col("words_distance") <= WORDS_LIMIT + WORDS_SLOPE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    return out.withColumn("kept", ~F.col("base_failed") & near)


def _histogram(top: list[tuple[int, str, int]], n: int) -> list[int]:
    out = [0] * COMMON + [n]
    for place, _, count in top:
        out[place], out[COMMON] = count, out[COMMON] - count
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    count = lambda x: f"length(regexp_replace(t, '[^{x}]', '', 'g'))"
    ascii_ = " - ".join(f"c{i}" for i in range(len(CLASSES)))
    classes = ", ".join(f"{count(x)} AS c{i}" for i, x in enumerate(CLASSES.values()))
    rows = lambda c, g: " UNION ALL ".join(f"SELECT uid, {g} AS grp, base_failed, total, {i} AS place, {x} AS n FROM {c}" for i, x in enumerate([*(f"c{i}" for i in range(len(CLASSES))), f"total - beyond - ({ascii_.replace(' - ', ' + ')})", "beyond"]))
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    return rf"""
WITH n AS (SELECT count(*) AS n FROM documents), often AS (SELECT lang FROM documents, n WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_DOCS} AND count(*) * {SHARE} >= any_value(n)),
d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN (FROM often) THEN lang ELSE '' END AS grp FROM documents),
w AS MATERIALIZED (SELECT uid, doc_id, grp, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT uid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT uid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT uid, count(DISTINCT i + k) AS n FROM (SELECT uid, i FROM win QUALIFY count(*) OVER (PARTITION BY uid, x) > 1), range(3) r(k) GROUP BY uid),
b AS MATERIALIZED (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM (
  SELECT uid, doc_id, grp, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{CLASSES["white"]}]', '', 'g')) AS BIGINT) AS word_chars, CAST({count(CLASSES["symbol"])} AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS total, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS beyond, {classes}
  FROM w LEFT JOIN rep USING (uid))),
chars AS MATERIALIZED ({rows("b", "grp")}),
share AS (SELECT grp, place, 1000 * n // total AS s, count(*) AS k FROM chars WHERE NOT base_failed GROUP BY ALL),
med AS (SELECT grp, place, min(s) AS m FROM (SELECT *, sum(k) OVER (PARTITION BY grp, place ORDER BY s) AS below, sum(k) OVER (PARTITION BY grp, place) AS every FROM share) WHERE 2 * below >= every GROUP BY 1, 2),
cref AS (SELECT grp, place, (coalesce(m, 0) + 0.5) / sum(coalesce(m, 0) + 0.5) OVER (PARTITION BY grp) AS q FROM (SELECT DISTINCT grp FROM d) CROSS JOIN range({len(_NAMES)}) t(place) LEFT JOIN med USING (grp, place)),
cd AS (SELECT uid, sqrt(greatest(sum({term.format("p", "q")} + {term.format("q", "p")}) / 2, 0)) AS dist FROM (SELECT uid, n / total AS p, q FROM chars JOIN cref USING (grp, place) WHERE total > 0) GROUP BY uid),
tok AS MATERIALIZED (SELECT uid, grp, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM w),
top AS MATERIALIZED (SELECT grp, word, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, word) - 1 AS place FROM tok GROUP BY 1, 2 QUALIFY place < {COMMON}),
wref AS (SELECT grp, place, n / sum(n) OVER (PARTITION BY grp) AS q FROM (SELECT grp, place, n FROM top UNION ALL SELECT grp, {COMMON}, (SELECT count(*) FROM tok WHERE tok.grp = g.grp) - coalesce((SELECT sum(n) FROM top WHERE top.grp = g.grp), 0) FROM (SELECT DISTINCT grp FROM tok) g)),
wn AS (SELECT uid, coalesce(place, {COMMON}) AS place, count(*) AS n FROM tok LEFT JOIN top USING (grp, word) GROUP BY 1, 2),
wd AS (SELECT uid, sqrt(greatest(sum({term.format("p", "q")} + {term.format("q", "p")}) / 2, 0)) AS dist FROM (SELECT b.uid, coalesce(wn.n, 0) / b.n_words AS p, q FROM b JOIN wref USING (grp) LEFT JOIN wn ON wn.uid = b.uid AND wn.place = wref.place WHERE b.n_words > 0) GROUP BY uid)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd.dist, 1) <= {CHARS_LIMIT} AND coalesce(wd.dist, 1) <= {WORDS_LIMIT} + {WORDS_SLOPE} / sqrt(greatest(n_words, 1)) AS kept
FROM b LEFT JOIN cd USING (uid) LEFT JOIN wd USING (uid)
"""


ORACLE = _oracle()
