"""Repeated passages across documents by collinear chaining of shared k-mer seeds.

Every document's words are cut into overlapping k-mers, of which the minimizers (the least hash
of each window) are seeds; any run of K + W - 1 equal words holds a common seed. A seed's first
occurrence (least id, then position) is the anchor of all later ones, so matches grow with the
input and never with the square of a group. The pieces of a passage may stand first in different
documents, so where seeds that repeat lie close together, runs of LONG words are seeds as well,
with anchors of their own: every run of LONG + DENSE - 1 equal words that stands in an earlier
document is matched to one that holds LONG of them in a row. Places that no passage holds then are
matched again by pairs of seeds and by a seed with a block of words near it, each of which has an
anchor as well: an altered passage is found unless for each such key that it shares with an alike
document another one is earlier. The matches of a document with another are joined
to segments along diagonals and chained in order: a segment's best predecessor ends before it
in both documents, and is found as a prefix maximum in a Fenwick tree over the other document's
positions, with a cost for each word skipped in near. Chains are aligned on the words: gaps
between segments by their longest common subsequence, whatever their lengths, ends by
extension while matches outweigh mismatches. What is long and alike enough is a passage; a chain
that is not alike enough as a whole is split, and its parts that are alike enough are passages.

Defined cases: null and empty texts, and those with fewer than K words, have no seeds. Null ids
take no part. Rows that repeat an id and a text count once; of an id with several texts, the one
with the largest hash is the document, and the others take no part. Repeats inside a document are not
looked at. Ties go to the smaller id and position. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm import common
from morphlake.llm.common import U, bounded_batches, dropped, mix, shingle_hashes, slices, stored_alone, table, word_hashes

K, W = 6, 12
#: Cost of a word skipped in either document, in matched words; words that a passage has at least; share that must match.
GAP, LEAST, ALIKE = 0.05, 48, 0.8
#: Seeds of a chain that is worth aligning; words beyond a chain's ends that are looked at.
SEEDS, MARGIN = 2, 48
#: Words on either side within which a seed has another of its chain: a cost of GAP a word leaves no more of a seed's K.
REACH = int(K / GAP) + K
#: Words on either side of a seed that tell it from other places of it, in blocks of so many: a passage of LEAST
#: words has no more beside a seed.
AROUND, BLOCK = LEAST, 4
OFFSETS = [*range(-AROUND, 0, BLOCK), *range(K, K + AROUND, BLOCK)]
#: Words of a long seed, and the window of which it is the least. One of them is worth SEEDS.
LONG, DENSE = LEAST, 3
#: What a word is compared by.
WORD = np.uint32
#: Words aligned at once; more are aligned block by block.
BITS = 4096
#: Rows of ids that may be broadcast (8 bytes each).
BROADCAST_ROWS = 2_000_000
#: Rows of a few numbers sent to Python at once.
NARROW_ROWS = 16_384

RESULT = "doc_id long, other_id long, start_word long, end_word long, other_start long, other_end long, matched long"


def minimizers(hashes: np.ndarray, splits: np.ndarray, counts: np.ndarray, width: int = W) -> np.ndarray:
    """Rows of the k-mers that are the least of some window of that width within their text (all texts
    at once; of texts with fewer k-mers, the least). The first of equal ones wins."""
    n = len(hashes)
    kept = np.zeros(n, bool)
    best, off = hashes, np.zeros(n, np.int16 if width < 1 << 15 else np.int64)
    covered = 1
    while covered < min(width, n):  # minima of windows of doubled width, then of the whole; one that crosses a text's end isn't used
        step = min(covered, width - covered)
        m = max(0, len(best) - step)
        swap = best[step:] < best[:m]
        best, off = np.where(swap, best[step:], best[:m]), np.where(swap, off[step:] + off.dtype.type(step), off[:m])
        covered += step
    size = np.diff(splits)
    if covered >= width:
        whole = np.zeros(n + 1, np.int8)  # where the windows that are whole begin
        some = size >= width
        whole[splits[:-1][some]] += 1
        whole[splits[1:][some] - width + 1] -= 1
        at = np.flatnonzero(np.cumsum(whole[:n], dtype=np.int8))
        kept[at + off[at]] = True
    for i in np.flatnonzero((size > 0) & (size < width)).tolist():
        kept[splits[i] + int(hashes[splits[i] : splits[i + 1]].argmin())] = True
    return np.flatnonzero(kept)


def first_in_text(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Rows, ascending, of each text's first of equal seeds."""
    if not len(seeds):
        return np.zeros(0, np.int64)
    order = np.argsort(mix(text.astype(U) + U(1)) ^ seeds)
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(seeds[order]) != 0) | (np.diff(text[order]) != 0)
    return np.sort(np.minimum.reduceat(order, np.flatnonzero(new)))


def long_seeds(words: np.ndarray, splits: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of LONG words, their texts and places, from where the short seeds at these places (by
    text, ascending) are so close that a repeated run of LONG words may lie there."""
    # In a repeated run, a seed starts within the first W words, and then one in each W words.
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(at) > W)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    text = text[first]
    begin = splits[text] + np.maximum(at[first] - (W - 1), 0)
    end = np.minimum(splits[text] + at[last] + K + W - 1, splits[text + 1])
    text, begin, size = (v[end - begin >= LONG] for v in (text, begin, end - begin - LONG + 1))
    if not len(begin):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = common._power_table(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words.astype(U) + U(1)) * up[: len(words)], out=total[1:])
        runs = mix((total[LONG:] - total[:-LONG]) * down[: len(words) - LONG + 1])
    ends = np.append(0, np.cumsum(size))
    place = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    own = minimizers(runs[place], ends, size, DENSE)
    place, once = np.unique(place[own], return_index=True)  # regions may overlap
    text = np.repeat(text, size)[own][once]
    return runs[place], text, place - splits[text]


def chains(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> list[tuple[list[tuple[int, int, int]], int]]:
    """Chains of matches of n words (K, if not given): segments (x, y, words) in order, and their seeds."""
    n = np.full(len(x), K) if n is None else n
    order = np.lexsort((x, x - y))
    x, y, n = x[order], y[order], n[order]
    new = np.ones(len(x), bool)
    new[1:] = np.diff(x - y) != 0
    apart = np.cumsum(new) * (int((x + n).max()) + 1)
    reach = np.maximum.accumulate(x + n + apart) - apart  # the furthest end on the diagonal so far
    new[1:] |= x[1:] - reach[:-1] > W - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    seeds = np.add.reduceat(np.where(n > K, SEEDS, 1), first)
    x0, y0, n = x[first], y[first], reach[last] - x[first]
    count = len(first)
    if count == 1:
        return [([(int(x0[0]), int(y0[0]), int(n[0]))], int(seeds[0]))]
    ys = np.unique(np.concatenate([y0, y0 + n]))
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ys) + 1)
    start_at, end_at = (np.searchsorted(ys, v).tolist() for v in (y0, y0 + n))
    score, back = [0.0] * count, [-1] * count
    xs, ys0, ns = x0.tolist(), y0.tolist(), n.tolist()
    # at equal x, ends come before starts: segments that touch may be chained
    events = sorted([(xs[i] + ns[i], 0, i) for i in range(count)] + [(xs[i], 1, i) for i in range(count)])
    for _, kind, i in events:
        if kind:  # start: the best predecessor that ended at or before this y
            best, k = (-np.inf, -1), start_at[i] + 1
            while k:
                best = max(best, tree[k])
                k -= k & -k
            reach = best[0] - GAP * (xs[i] + ys0[i])
            score[i] = ns[i] + max(0.0, reach)
            back[i] = best[1] if reach > 0 else -1
        else:
            value, k = (score[i] + GAP * (xs[i] + ys0[i] + 2 * ns[i]), i), end_at[i] + 1
            while k <= len(ys):
                if value > tree[k]:
                    tree[k] = value
                k += k & -k
    out, used = [], [False] * count
    for i in sorted(range(count), key=lambda i: (-score[i], xs[i], ys0[i])):
        if used[i]:
            continue
        chain, total = [], 0
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append((xs[i], ys0[i], ns[i]))
            total += int(seeds[i])
            i = back[i]
        out.append((chain[::-1], total))
    return out


def _only_segments(x: np.ndarray, y: np.ndarray, n: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """chains() of many pairs of documents at once, where it is plain: whether all matches of a pair are one segment,
    that segment, and its seeds. A pair's matches are ordered by diagonal (x - y) and place (x)."""
    pair = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x - y) != 0) | (np.diff(pair) != 0)
    apart = np.cumsum(new) * (int((x + n).max()) + 1)
    reach = np.maximum.accumulate(x + n + apart) - apart
    new[1:] |= x[1:] - reach[:-1] > W - 1
    at = edges[:-1]
    return np.add.reduceat(new, at, dtype=np.int64) == 1, np.stack([x[at], y[at], reach[edges[1:] - 1] - x[at]], axis=1), np.add.reduceat(np.where(n > K, SEEDS, 1), at)


def _gap_matches(u: np.ndarray, v: np.ndarray) -> int:
    """Equal words of the best alignment of two runs (longest common subsequence), at any length.
    A row of the alignment is the bits of numbers, BITS in each, so a word costs a few operations on them."""
    m = min(len(u), len(v))
    if not m:
        return 0
    unlike = np.flatnonzero(u[:m] != v[:m])
    head = int(unlike[0]) if len(unlike) else m
    u, v, m = u[head:], v[head:], m - head
    unlike = np.flatnonzero(u[len(u) - m :][::-1] != v[len(v) - m :][::-1])
    tail = int(unlike[0]) if len(unlike) else m
    u, v = u[: len(u) - tail], v[: len(v) - tail]
    u, v = u[np.isin(u, v)], v[np.isin(v, u)]  # no other word can be matched
    if not len(u):
        return head + tail
    if len(u) > len(v):
        u, v = v, u
    missed = 0
    carried = [0] * len(v)
    words = v.tolist()
    for block in (u[i : i + BITS] for i in range(0, len(u), BITS)):
        order = np.argsort(block, kind="stable")
        kinds, first = np.unique(block[order], return_index=True)
        places = {}
        for k, at in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
            flags = np.zeros(len(block), bool)
            flags[at] = True
            places[k] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        n = len(block)
        row = full = (1 << n) - 1
        for j, k in enumerate(words):
            met = row & places.get(k, 0)
            total = row + met + carried[j]
            carried[j] = total >> n
            row = (total | row - met) & full
        missed += row.bit_count()
    return head + tail + len(u) - missed


def _extension(same: np.ndarray, cost: int) -> tuple[int, int]:
    """Words, and equal ones, of the best extension: a match gains one, a mismatch costs so many."""
    if not len(same):
        return 0, 0
    total = np.cumsum(np.where(same, 1, -cost))
    best = int(total.argmax())
    return (best + 1, int(same[: best + 1].sum())) if total[best] > 0 else (0, 0)


def align(a: np.ndarray, b: np.ndarray, a0: int, b0: int, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain: start and end in both documents, and matched words. a and b are words
    from a0 and b0 on. A chain that is alike enough as a whole is one passage. Of any other, the
    parts (some segments in a row) that are long and alike enough, longest first, until each
    segment of such a part is in a passage."""
    chain = [(x - a0, y - b0, n) for x, y, n in chain if x - a0 + n <= len(a) and y - b0 + n <= len(b)]
    if not chain:
        return []
    x, y, n = np.array(chain, np.int64).T
    count = len(x)
    # words before each segment and after it, up to the next one
    xl, yl = np.append(0, x[:-1] + n[:-1]), np.append(0, y[:-1] + n[:-1])
    xr, yr = np.append(x[1:], len(a)), np.append(y[1:], len(b))

    def left(i: int, cost: int) -> tuple[int, int]:
        m = min(x[i] - xl[i], y[i] - yl[i])
        return _extension((a[x[i] - m : x[i]] == b[y[i] - m : y[i]])[::-1], cost)

    def right(i: int, cost: int) -> tuple[int, int]:
        p, q = x[i] + n[i], y[i] + n[i]
        m = min(xr[i] - p, yr[i] - q)
        return _extension(a[p : p + m] == b[q : q + m], cost)

    gaps = np.array([_gap_matches(a[x[i] + n[i] : x[i + 1]], b[y[i] + n[i] : y[i + 1]]) for i in range(count - 1)], np.int64)
    after = np.cumsum(n) + np.append(0, np.cumsum(gaps))  # matched words from the chain's start to a segment's end
    (l, lm), (r, rm) = left(0, 2), right(count - 1, 2)
    x0, x1, y0, y1, matched = (int(v) for v in (x[0] - l, x[-1] + n[-1] + r, y[0] - l, y[-1] + n[-1] + r, after[-1] + lm + rm))
    if matched >= ALIKE * max(x1 - x0, y1 - y0):
        return [(x0 + a0, x1 + a0, y0 + b0, y1 + b0, matched)] if x1 - x0 >= LEAST else []
    # At this cost, an extension is alike enough itself and never spoils a part.
    l, lm = np.array([left(i, 4) for i in range(count)], np.int64).T
    r, rm = np.array([right(i, 4) for i in range(count)], np.int64).T
    before, until = after - n - lm, after + rm
    start, end = (x - l, y - l), (x + n + r, y + n + r)
    found = []
    # In whole fifths of a word, so that no rounding decides.
    opens = [5 * before - int(5 * ALIKE) * s for s in start]
    closes = [5 * until - int(5 * ALIKE) * e for e in end]
    for i in range(count):
        j = i + int(np.flatnonzero((closes[0][i:] >= opens[0][i]) & (closes[1][i:] >= opens[1][i]))[-1])
        if end[0][j] - start[0][i] >= LEAST:
            found.append((i, j))
    held = np.zeros(count, bool)
    out = []
    for i, j in sorted(found, key=lambda p: (start[0][p[0]] - end[0][p[1]], p)):
        if not held[i : j + 1].all():
            held[i : j + 1] = True
            out.append(tuple(int(v) for v in (start[0][i] + a0, end[0][j] + a0, start[1][i] + b0, end[1][j] + b0, until[j] - before[i])))
    return sorted(out)


def _n_words(texts: pa.Array) -> np.ndarray:
    return pa.compute.binary_length(texts).to_numpy().astype(np.int64) // WORD().itemsize


def _single(a: pa.Array, b: pa.Array, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """align() of many chains of one segment each, in the words of a and b: whether the whole is alike enough, its
    start and end in both, and matched words."""
    (u, u_ends), (v, v_ends) = ((np.frombuffer(raw.tobytes(), WORD), ends // WORD().itemsize) for raw, ends in map(common.buffer_of, (a, b)))
    row = np.arange(len(x))

    def extension(p: np.ndarray, q: np.ndarray, m: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(max(1, int(m.max(initial=0))))
        inside = k < m[:, None]
        same = u[np.where(inside, p[:, None] + by * k, 0)] == v[np.where(inside, q[:, None] + by * k, 0)]
        total = np.cumsum(np.where(inside & same, 1, -2), axis=1)
        best = total.argmax(axis=1)
        words = np.where(total[row, best] > 0, best + 1, 0)
        return words, np.where(words > 0, (total[row, best] + 2 * words) // 3, 0)

    p, q = u_ends[:-1] + x, v_ends[:-1] + y
    l, lm = extension(p - 1, q - 1, np.minimum(x, y), -1)
    r, rm = extension(p + n, q + n, np.minimum(u_ends[1:] - p, v_ends[1:] - q) - n, 1)
    matched = n + lm + rm
    return matched >= ALIKE * (l + n + r), x - l, x + n + r, y - l, y + n + r, matched


def _words32(batch: pa.RecordBatch) -> pa.Array:
    """32 bits of each word's hash, as bytes of each text."""
    out: list[bytes] = []
    for piece in slices(batch, "__text"):
        words, splits = word_hashes(piece.column("__text"))
        short = (words >> U(32)).astype(WORD)
        out += [short[a:b].tobytes() for a, b in zip(splits[:-1].tolist(), splits[1:].tolist(), strict=True)]
    return pa.array(out, pa.binary())


def _one_text(texts: DataFrame) -> DataFrame:
    """texts without all but one of the texts of an id."""
    hashed = texts.withColumn("__hash", F.xxhash64("__text"))
    several = hashed.groupBy("__id").agg(F.max("__hash").alias("__top"), F.min("__hash").alias("__low")).filter("__top <> __low")
    several = stored_alone(texts.sparkSession, several.select("__id", "__top"), "several")
    n = several.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return texts
    kept = hashed.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "__id", "left").filter("__top IS NULL OR __top = __hash")
    return kept.select("__id", "__text")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage of a document that stands in an earlier one (RESULT)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = _one_text(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter("__id is not null"))

    def seed(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "__text"):
                words, splits = word_hashes(piece.column("__text"))
                counts = np.diff(splits)
                grams, ends = shingle_hashes(words, splits, K)
                own = minimizers(grams, ends, counts)
                text = np.searchsorted(ends, own, side="right") - 1
                own, text = own[counts[text] >= K], text[counts[text] >= K]
                if once:
                    rows = first_in_text(text, grams[own])
                    own, text = own[rows], text[rows]
                ids = piece.column("__id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(grams[own].view(np.int64)), pa.array(ids[text]), pa.array((own - ends[text]).astype(np.int32))], names=["seed", "id", "pos"])

    seeds = texts.mapInArrow(seed, "seed long, id long, pos int")
    # Stored, so that the join deals both sides anew and a hot seed's rows can be split.
    first = stored_alone(spark, _anchors(texts.mapInArrow(lambda batches: seed(batches, once=True), "seed long, id long, pos int")), "first")
    # With the anchors' own rows: they tell where a document's words repeat.
    matches = stored_alone(spark, seeds.join(first, "seed").select("id", "pos", "other", "at"), "matches")
    dropped(first)

    # The words of the documents that have seeds in common: 4 bytes each.
    wanted = stored_alone(spark, matches.select(F.col("id").alias("w")).distinct(), "wanted")
    held = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__id"), _words32(batch)], names=["w", "words"])

    words = texts.join(held, F.col("__id") == F.col("w"), "left_semi").mapInArrow(shorten, "w long, words binary").dropDuplicates(["w"])
    words = stored_alone(spark, words, "words")
    dropped(wanted)

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "words"):
                raw, offsets = common.buffer_of(piece.column("words"))
                lists = piece.column("places")
                text = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy())
                at = lists.flatten().to_numpy().astype(np.int64)
                order = np.lexsort((at, text))
                found, text, at = long_seeds(np.frombuffer(raw.tobytes(), WORD), offsets // WORD().itemsize, text[order], at[order])
                ids = piece.column("w").to_numpy()
                once = np.zeros(len(found), bool)
                once[first_in_text(text, found)] = True
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids[text]), pa.array(at.astype(np.int32)), pa.array(once)], names=["seed", "id", "pos", "once"])

    places = matches.groupBy("id").agg(F.collect_set("pos").alias("places"))
    long = places.join(words, F.col("id") == F.col("w")).select("w", "words", "places").mapInArrow(lengthen, "seed long, id long, pos int, once boolean")
    long = stored_alone(spark, long, "long")
    first = stored_alone(spark, _anchors(long.filter("once")), "long_first")
    more = long.join(first, "seed").filter("id <> other").select("id", "pos", "other", "at", F.lit(LONG).alias("n"))
    held_matches = matches
    matches = matches.filter("id <> other").withColumn("n", F.lit(K)).unionByName(more)

    found = stored_alone(spark, _passages_of(matches.withColumn("new", F.lit(True)), words), "found")
    dropped(long, first)
    rest = stored_alone(spark, _passages_of(_left_open(held_matches, found, words), words), "rest")
    dropped(held_matches)
    return found.unionByName(rest)


def _anchors(seeds: DataFrame) -> DataFrame:
    """The first document of each seed that stands in several (other), and its place there (at), by the seeds' first
    places in each document. All sums are plain numbers, so rows are grouped by hashing and not sorted."""
    first = seeds.groupBy("seed").agg(F.min("id").alias("other"), F.min_by("pos", "id").alias("at"), F.max("id").alias("top"))
    return first.filter("other <> top").select("seed", "other", "at")


@contextmanager
def _narrow(spark: SparkSession) -> Iterator[None]:
    """Jobs in here send rows of a few numbers to Python, and so more of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(NARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _left_open(matches: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """Matches of the places that no passage found so far holds, by keys that tell more than a seed does: pairs of
    seeds within REACH words, as a chain has SEEDS of them, and a seed with BLOCK words at one distance from it, as
    most of a passage's words are equal. A key's first document is its anchor, and each open place is matched with
    the anchors of its keys, so rows grow with the places and never with the square of those that share a phrase.
    New are the matches with other documents than the seed's own anchor."""
    spark = matches.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = found.select(F.col("doc_id").alias("id"), F.col("start_word").cast("int").alias("pos"), F.lit(None).cast("long").alias("other"), F.col("end_word").cast("int").alias("at"))
    # By one number only, which Spark sorts by its digits; numpy orders the rows of a document.
    dealt = lambda df: df.repartition(parts, "id").sortWithinPartitions("id")
    with _narrow(spark):
        places = stored_alone(spark, dealt(matches.select("id", "pos", "other", "at").unionByName(spans)).mapInArrow(_open_places, "id long, pos int, other long, at int, open boolean"), "places")
    # Only the seeds of open places are matched.
    anchors = stored_alone(spark, places.filter("open").select("other", "at").distinct(), "anchors")
    marked = places.join(anchors.withColumn("wanted", F.lit(True)), ["other", "at"], "left").select("id", "pos", "other", "at", "open", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    with _narrow(spark):
        near = stored_alone(spark, dealt(marked).mapInArrow(_surroundings, "id long, pos int, other long, at int, open boolean, pairs array<long>"), "near")
    dropped(places, anchors)

    start = F.greatest(F.lit(0), F.col("pos") - AROUND)
    cut = F.substring(F.col("words"), 4 * start + 1, 4 * (F.col("pos") + K + AROUND - start))
    around = near.select("id", "pos", "other", "at", "open").join(words, F.col("id") == F.col("w")).select("id", "pos", "other", "at", "open", cut.alias("cut"))
    blocks = stored_alone(spark, around.mapInArrow(_blocks, "id long, pos int, other long, open boolean, blocks array<long>"), "blocks")

    by_pair = _with_anchors(near.select("id", "pos", "other", "open", F.explode("pairs").alias("key")))
    by_block = _with_anchors(blocks.select("id", "pos", "other", "open", F.posexplode("blocks").alias("k", "key")).filter("key is not null"))
    # A block is as good as a seed, where it stands. It is matched beside the seed it was found by.
    by = F.element_at(F.array(*(F.lit(o) for o in OFFSETS)), F.col("k") + 1)
    rows = lambda pos, at, n: F.struct(pos.cast("int").alias("pos"), at.cast("int").alias("at"), F.lit(n).alias("n"))
    seed = rows(F.col("pos"), F.col("e_pos"), K)
    by_block = by_block.select("id", "e_id", "other", F.explode(F.array(seed, rows(F.col("pos") + by, F.col("e_pos") + by, BLOCK))).alias("m"))
    both = by_pair.select("id", "e_id", "other", seed.alias("m")).unionByName(by_block).groupBy("id", "e_id", "m").agg(F.max(F.col("e_id") != F.col("other")).alias("new"))
    both = stored_alone(spark, both.select("id", F.col("e_id").alias("other"), "m.pos", "m.at", "m.n", "new"), "pairs")
    dropped(near, blocks)
    return both


def _with_anchors(rows: DataFrame) -> DataFrame:
    """The open rows with their key's first document and place (e_id, e_pos), if it is an earlier document."""
    first = rows.groupBy("key").agg(F.min(F.struct("id", "pos")).alias("e"), F.max(F.when(F.col("open"), F.col("id"))).alias("top")).filter("e.id < top")
    # Stored, so that the join deals both sides anew and a hot key's rows can be split.
    first = stored_alone(rows.sparkSession, first.select("key", F.col("e.id").alias("e_id"), F.col("e.pos").alias("e_pos")), "key_first")
    return rows.filter("open").join(first, "key").filter("e_id < id")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places with the words around them (cut), a key of the seed with BLOCK words at each of OFFSETS; null
    where the text ends before."""
    for batch in batches:
        pos, other, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("pos", "other", "at"))
        m = np.zeros((len(pos), 2 * AROUND + K), U)
        begin = AROUND - np.minimum(pos, AROUND)
        end = begin.copy()
        for i, raw in enumerate(batch.column("cut").to_pylist()):
            v = np.frombuffer(raw, WORD)
            end[i] += len(v)
            m[i, begin[i] : end[i]] = v
        with np.errstate(over="ignore"):
            seed = mix(mix(other.view(U)) + at.view(U))
            keys = np.empty((len(pos), len(OFFSETS)), U)
            for k, o in enumerate(OFFSETS):
                h = mix(seed + U(k + 1))
                for j in range(AROUND + o, AROUND + o + BLOCK):
                    h = mix((h ^ m[:, j]) + U(1))
                keys[:, k] = h
        low = np.array(OFFSETS) + AROUND
        null = (low < begin[:, None]) | (low + BLOCK > end[:, None])
        ends = pa.array(np.arange(len(pos) + 1, dtype=np.int32) * len(OFFSETS))
        lists = pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel(), mask=null.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "pos", "other", "open")), lists], names=["id", "pos", "other", "open", "blocks"])


def _open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of matches and passages (pos to at, without other) by document, the matches; open are those of
    another document that no passage holds. Rows that repeat a place count once."""
    for now in _whole_documents(batches, "id"):
        ids, pos, at = (now.column(c).to_numpy().astype(np.int64) for c in ("id", "pos", "at"))
        span = now.column("other").is_null().to_numpy()
        apart = np.cumsum(np.diff(ids, prepend=ids[0]) != 0) * (int(max(pos.max(), at.max())) + 2 * K)
        order = np.lexsort((~span, pos + apart))  # passages that start at a place hold it
        now, ids, pos, at, span, apart = now.take(pa.array(order)), *(v[order] for v in (ids, pos, at, span, apart))
        until = np.maximum.accumulate(np.where(span, at + apart, -1)) - apart
        own = ~span
        own[1:] &= span[:-1] | (np.diff(ids) != 0) | (np.diff(pos) != 0)
        other = now.column("other").fill_null(0).to_numpy()
        free = (other != ids) & (until < pos + K)
        yield pa.RecordBatch.from_arrays([*(now.column(c).combine_chunks().filter(pa.array(own)) for c in ("id", "pos", "other", "at")), pa.array(free[own])], names=["id", "pos", "other", "at", "open"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the wanted places that are open or their seed's first in the document: their pairs with the seeds within
    REACH words. A place without another place of a seed is left out, and isn't the first."""
    for now in _whole_documents(batches, "id"):
        ids, pos = (now.column(c).to_numpy().astype(np.int64) for c in ("id", "pos"))
        now = now.take(pa.array(np.lexsort((pos, np.cumsum(np.diff(ids, prepend=ids[0]) != 0)))))
        ids, pos, other, at = (now.column(c).to_numpy().astype(np.int64) for c in ("id", "pos", "other", "at"))
        wanted = np.flatnonzero(now.column("wanted").to_numpy())
        if not len(wanted):
            continue
        with np.errstate(over="ignore"):
            seed = mix(mix(other.view(U)) + at.view(U))
        key = np.cumsum(np.diff(ids, prepend=ids[0]) != 0) * (int(pos.max()) + 2 * REACH + 1) + pos

        def within(places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
            return np.searchsorted(key, key[places] - reach), np.searchsorted(key, key[places] + reach, side="right")  # noqa: B023

        def spread(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(len(size)), size), np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)

        low, high = within(wanted, REACH)
        some = high - low > 1
        wanted, low, high = wanted[some], low[some], high[some]
        order = np.lexsort((pos[wanted], seed[wanted], ids[wanted]))
        first = np.ones(len(order), bool)
        first[order[1:]] = (np.diff(ids[wanted][order]) != 0) | (np.diff(seed[wanted][order]) != 0)
        used = first | now.column("open").to_numpy()[wanted]
        wanted, first, low, high = wanted[used], first[used], low[used], high[used]
        if not len(wanted):
            continue
        row, there = spread(low, high - low)
        with np.errstate(over="ignore"):
            pair = mix(seed[wanted[row]] ^ mix(seed[there] + U(1))).view(np.int64)
        order = np.lexsort((pair, row))
        order = order[there[order] != wanted[row[order]]]
        new = np.ones(len(order), bool)  # a seed that stands there again makes no other pair
        new[1:] = (np.diff(row[order]) != 0) | (np.diff(pair[order].view(U)) != 0)
        row, pair = row[order][new], pair[order][new]
        ends = pa.array(np.searchsorted(row, np.arange(len(wanted) + 1)).astype(np.int32))
        now = now.take(pa.array(wanted))
        columns = (now.column(c).combine_chunks() for c in ("id", "pos", "other", "at", "open"))
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(pair))], names=["id", "pos", "other", "at", "open", "pairs"])


def _whole_documents(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """The rows of sorted batches, with all that have these values equal in one table."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unlike = np.zeros(batch.num_rows, bool)
        for name in names:
            v = batch.column(name).to_numpy()
            unlike |= v != v[-1]
        edge = np.flatnonzero(unlike)
        cut = int(edge[-1]) + 1 if len(edge) else 0
        last = [left[-1].column(name)[-1].as_py() for name in names] if left else None
        if left and (cut or [batch.column(name)[-1].as_py() for name in names] != last):
            # The rows so far end in this batch, or ended with the last one.
            yield pa.Table.from_batches([*left, batch.slice(0, cut)]).combine_chunks()
            left = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        left.append(batch.slice(cut))
    if left:
        yield pa.Table.from_batches(left).combine_chunks()


def _passages_of(matches: DataFrame, words: DataFrame) -> DataFrame:
    """Passages (RESULT) by matches of n words, of pairs of documents with a new one. words has those of the documents."""
    spark = matches.sparkSession

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in _whole_documents(batches, "id"):
            a, b, x, y, n = (now.column(c).to_numpy().astype(np.int64) for c in ("id", "other", "pos", "at", "n"))
            order = np.lexsort((x, x - y, b, a))
            a, b, x, y, n, new = *(v[order] for v in (a, b, x, y, n)), now.column("new").to_numpy()[order]
            first = np.flatnonzero(np.diff(a, prepend=a[0] - 1) | np.diff(b, prepend=b[0] - 1))
            edges = np.append(first, len(a))
            used = ((np.diff(edges) >= SEEDS) | (n[first] != K)) & np.logical_or.reduceat(new, first)
            alone, segment, total = _only_segments(x, y, n, edges)
            alone, whole = alone & used, alone & used & (total >= SEEDS)
            if whole.any():
                chain_ends = pa.array(3 * np.arange(whole.sum() + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(a[first[whole]]), pa.array(b[first[whole]]), pa.ListArray.from_arrays(chain_ends, pa.array(segment[whole].astype(np.int32).ravel()))], names=["id", "other", "chain"])
            rows = []
            for k in np.flatnonzero(used & ~alone).tolist():
                i, j = int(edges[k]), int(edges[k + 1])
                for segments, seeds in chains(x[i:j], y[i:j], n[i:j]):
                    if seeds >= SEEDS:
                        rows.append((a[i], b[i], [v for s in segments for v in s]))
            if rows:
                one, two, three = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(three, pa.list_(pa.int32()))], names=["id", "other", "chain"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = matches.repartition(parts, "id", "other").sortWithinPartitions("id")
    with _narrow(spark):
        made = stored_alone(spark, dealt.mapInArrow(chain, "id long, other long, chain array<int>"), "chains")

    end = lambda k: F.element_at("chain", -3 + k) + F.element_at("chain", -1)
    cut = lambda start, stop: F.substring(F.col("words"), 4 * start + 1, 4 * (stop - start))
    placed = made.select("*", F.greatest(F.lit(0), F.get("chain", 0) - MARGIN).alias("a0"), (end(0) + MARGIN).alias("a1"), F.greatest(F.lit(0), F.get("chain", 1) - MARGIN).alias("b0"), (end(1) + MARGIN).alias("b1"))
    theirs = placed.join(words, F.col("other") == F.col("w")).select("id", "other", "chain", "a0", "a1", "b0", cut(F.col("b0"), F.col("b1")).alias("b"))
    both = theirs.join(words, F.col("id") == F.col("w")).select("id", "other", "chain", "a0", "b0", "b", cut(F.col("a0"), F.col("a1")).alias("a"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            # Nearly all chains are one segment, and nearly all of these are alike enough as a whole.
            one = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("chain")), 3))
            rest = [batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("chain")), 3))]
            if one.num_rows:
                x, y, n = one.column("chain").flatten().to_numpy().astype(np.int64).reshape(-1, 3).T
                a0, b0 = (one.column(c).to_numpy().astype(np.int64) for c in ("a0", "b0"))
                held = (x - a0 + n <= _n_words(one.column("a"))) & (y - b0 + n <= _n_words(one.column("b")))
                one, x, y, n, a0, b0 = one.filter(pa.array(held)), *(v[held] for v in (x, y, n, a0, b0))
                alike, x0, x1, y0, y1, matched = _single(one.column("a"), one.column("b"), x - a0, y - b0, n)
                long = alike & (x1 - x0 >= LEAST)
                yield pa.RecordBatch.from_arrays([*(one.column(c).filter(pa.array(long)) for c in ("id", "other")), *(pa.array(v[long], pa.int64()) for v in (x0 + a0, x1 + a0, y0 + b0, y1 + b0, matched))], names=names)
                rest.append(one.filter(pa.array(~alike)))
            rows = []
            for part in rest:
                for i, o, c, a0, b0, a, b in zip(*(part.column(n).to_pylist() for n in ("id", "other", "chain", "a0", "b0", "a", "b")), strict=True):
                    rows += [(i, o, *p) for p in align(np.frombuffer(a, WORD), np.frombuffer(b, WORD), a0, b0, list(zip(c[0::3], c[1::3], c[2::3], strict=True)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=names)

    return both.mapInArrow(lay, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
