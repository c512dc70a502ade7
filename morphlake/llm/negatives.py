"""Hard negatives: rows of another label that score high against an anchor, but not as high as its
positives.

The index is inverted lists: k-means, fitted on a bounded sample, deals every row to the list of its
nearest centroid, and each list stores its radius, the distance of its farthest row. By Cauchy-Schwarz
no row x of a list with centroid c and radius r scores outside a.c - |a| r and a.c + |a| r against an
anchor a. Each anchor visits lists by upper bound, in a few rounds: lists that lie outside of every
window are skipped, and a list whose bound falls strictly below the k-th score so far ends a window.
Within a round, tasks get one block of rows (a list, a part of a long list, or some short ones) and the
anchors that visit it, and go on skipping by what they have found themselves. So nothing is approximate,
whatever the sample is like.

The search runs twice: once for the best rows of the anchor's own label (the positives), and once for
those of other labels in the window below each positive.

Defined cases: rows with a null id, label or vector, or with null or non-finite components, take no
part; missing components of shorter vectors count as zero; rows that repeat an id are each a row (a row
is never its own positive, but its repeats may be), and repeated anchors give repeated results; ties go to the
smaller id. Scores beyond 64 bits count as the nearest number of 64 bits. An anchor with no other row
of its label, or none in the window, gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.llm.common import bounded_batches, dropped, stored_alone, table
from morphlake.llm.vectors import add_groups, lists, matrix, products, sound

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Rows a list has on average, and the least and most number of lists.
LIST_ROWS, FEWEST, MOST = 1024, 16, 4096
#: Rows, and bytes of them, that centroids are fitted on; rounds of that fit.
SAMPLE, SAMPLE_BYTES, FITS = 20_000, 64 << 20, 10
#: Least number of blocks that rows are dealt into, rows of a block and anchors of a group at most, about.
BLOCKS, BLOCK_ROWS, GROUP = 64, 4096, 1024
#: Shares of an anchor's lists, by bound, after which the scores found so far are shared.
ROUNDS = (1 / 16, 1 / 4, 1)
#: Scores of one step.
CELLS = 1 << 20
_LEAST, _LARGEST = -(2**63), 2**63 - 1

_ROW = "uid bigint, id bigint, label string, anchor boolean, list int, radius double, v array<double>"
_VISIT = "block bigint, grp bigint, uid bigint, label string, v array<double>, lists array<int>, bounds array<double>, lows array<bigint>, highs array<bigint>, bars array<bigint>"
_FOUND = "uid bigint, win int, score bigint, id bigint, other bigint"


@dataclass
class Index:
    """Rows with their lists, and for each list its centroid, radius, first block and number of blocks; the same for the groups of anchors."""

    rows: DataFrame
    width: int
    centroids: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    group: np.ndarray
    groups: np.ndarray


def fit_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from rows spread over x. A centroid without rows stays."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(FITS if len(x) else 0):
        n, sums = np.zeros(len(c), np.int64), np.zeros_like(c)
        add_groups(n, sums, nearest(x, c), x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    step = max(1, CELLS // len(c))
    return np.concatenate([(half - x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def bounds(a: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score of any row of each list against each anchor, with room for rounding."""
    size, reach = np.sqrt((a * a).sum(1))[:, None], radius + 1e-9 * (np.sqrt((c * c).sum(1)) + radius)
    mid = a @ c.T
    return mid - size * reach, mid + size * reach


def _packed(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each list: long lists get several, short neighbours share one."""
    first, parts, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for i, n in enumerate(sizes.tolist()):
        if n > most:
            parts[i] = -(-n // most)
            first[i], at, room = at + 1, at + int(parts[i]), 0
            continue
        if n > room or at < 0:
            at, room = at + 1, most
        first[i], room = at, room - n
    return first, parts


def build(vectors: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> Index:
    """The lists of all rows. Only the centroids hang on the sample, which is chosen by a hash of the id."""
    spark = vectors.sparkSession
    raw = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), raw.alias("raw"))
    rows = rows.filter(sound(F.col("raw")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("raw")), F.lit(0))).first()
    k = min(MOST, max(FEWEST, -(-n // LIST_ROWS)))
    some = min(SAMPLE, max(k, SAMPLE_BYTES // (8 * max(width, 1))))
    drawn = rows.select("raw", F.xxhash64("id").alias("h")).orderBy("h").limit(some).drop("h").toArrow()  # at most SAMPLE rows
    c = fit_centroids(np.floor(scale * matrix(drawn.column("raw"), width)), k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(scale * matrix(b.column("raw"), width))
            own = nearest(x, c)
            far = np.sqrt(((x - c[own]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("label"), b.column("anchor"), pa.array(own, pa.int32()), pa.array(far), lists(x, pa.float64())], ["uid", "id", "label", "anchor", "list", "radius", "v"])

    placed = stored_alone(spark, rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(assign, _ROW), "lists")
    sizes, heads, radius = (np.zeros(len(c), t) for t in (np.int64, np.int64, np.float64))
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a"), F.max("radius").alias("r")).collect():  # a row a list
        sizes[r.list], heads[r.list], radius[r.list] = r.n, r.a, r.r
    first, parts = _packed(sizes, min(BLOCK_ROWS, max(64, n // BLOCKS)))
    group, groups = _packed(heads, GROUP)
    return Index(placed, width, c, radius, sizes, first, parts, group, groups)


def search(index: Index, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """uid, win, rank, score, id, other: the k best rows of each window (uid, win, low, high) of an anchor, of
    its own label or of others. At least k scores above a bound end a window."""
    spark = index.rows.sparkSession
    anchors = index.rows.filter("anchor").select("uid", "label", "list", "v")
    place = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(index.first, index.parts))], "list int, __f bigint, __p bigint")  # a row a list
    rows = index.rows.join(F.broadcast(place), "list").select((F.col("__f") + F.pmod(F.xxhash64("uid"), "__p")).alias("block"), "uid", "id", "label", "list", "v")
    best, start, count = None, 0, len(index.centroids)
    for share in ROUNDS:
        stop = max(start + 1, int(np.ceil(share * count)))
        if start >= count:
            break
        bar = F.lit(_LEAST).cast("bigint").alias("bar")
        now = windows.select("*", bar) if best is None else windows.join(best.filter(F.col("rank") == k).select("uid", "win", F.col("score").alias("bar")), ["uid", "win"], "left").withColumn("bar", F.coalesce("bar", bar))
        per = now.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("win", "low", "high", "bar"))).alias("w"))  # as many as an anchor has positives
        asked = anchors.join(per, "uid").select("uid", "label", "list", "v", *(F.col(f"w.{c}").alias(f"{c}s") for c in ("low", "high", "bar")))
        visits = stored_alone(spark, asked.mapInArrow(_visitor(index, start, stop), _VISIT), "visits")
        start = stop
        visited = visits.select(F.col("block").alias("__block"), F.col("grp").alias("__grp")).distinct()
        dealt = rows.join(visited, F.col("block") == F.col("__block")).drop("block").groupBy("__block", "__grp")
        found = dealt.cogroup(visits.groupBy("block", "grp")).applyInArrow(_scorer(index.width, k, same), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        order = Window.partitionBy("uid", "win").orderBy(F.desc("score"), "id", "other")
        after = stored_alone(spark, found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        dropped(visits, *([best] if best is not None else []))
        best = after
    return best


def _visitor(index: Index, start: int, stop: int) -> Callable:
    """Which blocks each anchor visits in a round: of the lists that stand from start to stop in order of upper
    bound, those that may hold a row of a window that beats its bar."""
    c, radius, sizes, first, parts, group, groups, width = index.centroids, index.radius, index.sizes, index.first, index.parts, index.group, index.groups, index.width

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, CELLS // len(c))):
                b = whole.slice(at, step)
                low, high = bounds(matrix(b.column("v"), width), c, radius)
                place = np.empty_like(high, np.int64)
                np.put_along_axis(place, np.argsort(-high, axis=1, kind="stable"), np.arange(len(c))[None, :], 1)
                useful = np.zeros(high.shape, bool)
                lows, highs, bars = (x.astype(np.float64) for x in _windows(b))
                for j in range(lows.shape[1]):
                    useful |= (high >= np.maximum(lows, bars)[:, j, None]) & (low <= highs[:, j, None])
                a, l = np.nonzero(useful & (place >= start) & (place < stop) & (sizes > 0))  # noqa: E741
                a, l, part = np.repeat(a, parts[l]), np.repeat(l, parts[l]), np.arange(parts[l].sum()) - np.repeat(np.cumsum(parts[l]) - parts[l], parts[l])  # noqa: E741
                block = first[l] + part
                order = np.lexsort((l, block, a))
                a, l, block = a[order], l[order], block[order]  # noqa: E741
                if not len(a):
                    continue
                heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (block[1:] != block[:-1])])
                ends = pa.array(np.r_[heads, len(a)], pa.int32())
                who = pa.array(a[heads])
                own, uid = b.column("list").to_numpy()[a[heads]], b.column("uid").to_numpy()[a[heads]]
                grp = group[own] + uid % groups[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[heads]), pa.array(grp), *(b.column(x).take(who) for x in ("uid", "label", "v")), pa.ListArray.from_arrays(ends, pa.array(l, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(high[a, l])), *(b.column(x).take(who) for x in ("lows", "highs", "bars"))],
                    ["block", "grp", "uid", "label", "v", "lists", "bounds", "lows", "highs", "bars"],
                )

    return visit


def _windows(visits: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low end, high end and bar of each window of each anchor; an anchor with fewer windows has empty ones."""
    many = pc.list_value_length(visits.column("lows")).to_numpy()
    w = int(many.max(initial=1))
    lows, highs, bars = (matrix(visits.column(c), w, np.int64) for c in ("lows", "highs", "bars"))
    none = np.arange(w)[None, :] >= many[:, None]
    return np.where(none, _LARGEST, lows), np.where(none, _LEAST, highs), bars.copy()


def _first(k: int, q: np.ndarray, score: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best of each q: by score, then id."""
    order = np.lexsort((other, ids, -score, q))
    q = q[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    inside = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
    kept = order[inside < k]
    return q[inside < k], score[kept], ids[kept], other[kept]


def _scorer(width: int, k: int, same: bool) -> Callable:
    schema = pa.schema([("uid", pa.int64()), ("win", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("other", pa.int64())])

    def score(rows: pa.Table, visits: pa.Table) -> pa.Table:
        if not rows.num_rows or not visits.num_rows:
            return schema.empty_table()
        m = visits.num_rows
        codes = np.unique(np.array(rows.column("label").to_pylist() + visits.column("label").to_pylist(), object).astype(str), return_inverse=True)[1]
        order = np.lexsort((codes[: rows.num_rows], rows.column("list").to_numpy()))
        x, code, of = matrix(rows.column("v"), width)[order], codes[: rows.num_rows][order], rows.column("list").to_numpy()[order]
        ids, uid = rows.column("id").to_numpy()[order], rows.column("uid").to_numpy()[order]
        a, mine, own = matrix(visits.column("v"), width), codes[rows.num_rows :], visits.column("uid").to_numpy()
        lows, highs, bars = _windows(visits)
        w = lows.shape[1]
        pairs = np.asarray(visits.column("lists").combine_chunks().flatten())
        bound = np.asarray(visits.column("bounds").combine_chunks().flatten())
        who = np.repeat(np.arange(m), pc.list_value_length(visits.column("lists")).to_numpy())
        best = (np.zeros(0, np.int64),) * 4
        for l in sorted(set(pairs.tolist()), key=lambda y: -bound[pairs == y].max()):  # noqa: E741
            here = pairs == l
            ok = (bound[here, None] >= np.maximum(lows[who[here]], bars[who[here]]).astype(np.float64)).any(1)
            anchors = who[here][ok]
            r0, r1 = np.searchsorted(of, l), np.searchsorted(of, l, side="right")
            if not len(anchors) or r0 == r1:
                continue
            found = [best]
            for some, s0, s1 in _slices(anchors, mine, code, r0, r1, same):
                for at in range(0, len(some), step := max(1, CELLS // (s1 - s0))):
                    t = some[at : at + step]
                    s = products(a[t], x[s0:s1])
                    allowed = uid[None, s0:s1] != own[t, None] if same else code[None, s0:s1] != mine[t, None]
                    for j in range(w):
                        found.append(_picked(s, allowed, lows[t, j], highs[t, j], bars[t, j], k, t * w + j, ids[s0:s1], uid[s0:s1]))
            best = _first(k, *(np.concatenate(y) for y in zip(*found)))
            full = np.bincount(best[0], minlength=m * w) == k
            last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True]) if len(best[0]) else np.zeros(0, np.int64)
            last = last[full[best[0][last]]]
            flat = bars.reshape(-1)
            flat[best[0][last]] = np.maximum(flat[best[0][last]], best[1][last])
        q, s, i, o = best
        return pa.table([own[q // w], (q % w).astype(np.int32), s, i, o], schema=schema)

    return score


def _slices(anchors: np.ndarray, mine: np.ndarray, code: np.ndarray, r0: int, r1: int, same: bool) -> Iterator[tuple[np.ndarray, int, int]]:
    """Anchors with the rows of a list that they look at: all of them, or those of their label."""
    if not same:
        yield anchors, r0, r1
        return
    for label in np.unique(mine[anchors]):
        s0, s1 = r0 + np.searchsorted(code[r0:r1], label), r0 + np.searchsorted(code[r0:r1], label, side="right")
        if s1 > s0:
            yield anchors[mine[anchors] == label], s0, s1


def _picked(s: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, bar: np.ndarray, k: int, q: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best allowed scores of each row of s within its window and not below its bar, with their ties."""
    good = allowed & (s >= np.maximum(low, bar)[:, None]) & (s <= high[:, None])
    if s.shape[1] > k:
        kth = np.partition(np.where(good, s, _LEAST), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        good &= s >= kth[:, None]
    i, j = np.nonzero(good)
    return _first(k, q[i], s[i, j], ids[j], uid[j])


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that anchor
    holds for and each of its positives, the best rows of other labels whose scores lie from low to high
    percent of the positive's."""
    bounded_batches(vectors.sparkSession)
    index = build(vectors, anchor, id_col, label_col, vector_col, scale)
    named = index.rows.filter("anchor").select("uid", F.col("id").alias("anchor_id"))
    every = named.select("uid", F.lit(0).alias("win"), F.lit(_LEAST).cast("bigint").alias("low"), F.lit(_LARGEST).cast("bigint").alias("high"))
    found = search(index, every, positives, same=True).select("uid", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda part, to: F.expr(f"cast({to}(cast(positive_score as decimal(20,0)) * {part} / 100) as decimal(20,0))")
    held = lambda x: F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(_LEAST)).cast("bigint")
    windows = found.select("uid", "win", held(share(low, "ceil")).alias("low"), held(share(high, "floor")).alias("high")).filter("low <= high")
    worst = search(index, windows, negatives, same=False).select("uid", "win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(worst, ["uid", "win"]).join(named, "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.uid <> c.uid
), p AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.uid, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""
