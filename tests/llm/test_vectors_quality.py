"""Hard negatives, vector codes and quality rules against plain versions, and their defined cases."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from morphlake.llm import negatives, quality, vectorcodes
from morphlake.llm.vectors import matrix, products
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, label int"


def good(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def brute_negatives(rows, every=100, positives=5, negatives_=10):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, vector, label)."""
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in e], y) for i, e, y in rows if good(e) and y is not None and i is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, a, y) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-dot(a, e), j, z) for m, (j, e, z) in enumerate(rows) if m != n)
        for p, j, _ in [x for x in scored if x[2] == y][:positives]:
            window = [x for x in scored if x[2] != y and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives_]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(window)]
    return sorted(out)


def mined(df, **more):
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def clustered(n, labels=4, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, width)) * 2
    of = rng.integers(0, 12, n)
    x = (centre[of] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)
    return [(i, x[i].tolist(), int((of[i] + (rng.random() < 0.4)) % labels)) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = clustered(1500)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert mined(df) == brute_negatives(rows) != []


def test_negatives_defined_cases(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (7, [0.5, 0.25], 1), (8, [0.4, 0.4], 2), (9, [0.4, 0.4], 2), (9, [0.4, 0.4], 2), (10, [0.2], 3), (11, [], 3), (12, None, 1), (13, [None, 1.0], 2),
            (14, [float("nan"), 1.0], 2), (15, [float("inf"), 1.0], 2), (16, [0.1, 0.1], None), (None, [0.1, 0.1], 2), (200, [-0.5, 0.1], 9), (300, [0.1, -0.5], 2), (17, [0.3, 0.3], 4), (18, [-0.3, 0.3], 4)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("uid", F.lit("clash")).withColumn("rank", F.lit(None).cast("int"))
    wide = [(i, e if e is None else e + [0.0] * (2 - len(e)), y) for i, e, y in rows]
    assert mined(df) == brute_negatives(wide) != []
    assert mined(df.limit(0)) == []
    same = [(i, [0.25, 0.25], i % 2) for i in range(301)]  # one vector only: all is a tie
    assert mined(spark.createDataFrame(same, VECTORS)) == [] == brute_negatives(same)
    near = [(i, [1.0, 0.0] if i % 2 else [0.8, 0.0], i % 2) for i in range(301)]  # 0.8 * 0.8 against 0.8: above 90 %; ties within
    assert mined(spark.createDataFrame(near, VECTORS)) == brute_negatives(near)
    huge = [(i, [3e30 * (1 + i % 3), 1.0], i % 3) for i in range(101)]
    assert all(abs(s) <= 2**63 - 1 for r in mined(spark.createDataFrame(huge, VECTORS)) for s in r[4:])


def test_visits_skip_lists_that_bounds_exclude(spark):
    df = spark.createDataFrame(clustered(1500), VECTORS)
    index = negatives.build(df, F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding", 256)
    x = [r for r in index.rows.collect()]
    low, high = negatives.bounds(np.array([r.v for r in x[:50]]), index.centroids, index.radius)
    s = products(np.array([r.v for r in x[:50]]), np.array([r.v for r in x]))
    of = np.array([r.list for r in x])
    assert (s <= high[:, of]).all() and (s >= low[:, of]).all() and sorted(index.sizes.tolist()) == sorted(Counter(of.tolist()).get(i, 0) for i in range(len(index.sizes)))
    batch = pa.RecordBatch.from_pylist([{"uid": r.uid, "list": r.list, "label": r.label, "v": r.v, "lows": [-(2**63)], "highs": [2**63 - 1], "bars": [int(np.sort(s[i])[-6])]} for i, r in enumerate(x[:50])])
    seen = [b for b in negatives._visitor(index, 0, len(index.centroids))([batch])]
    visited = sum(len(y) for b in seen for y in b.column("lists").to_pylist())
    assert 50 <= visited < 50 * len(index.centroids) / 2  # most lists are skipped, those with the best rows are not
    by = {u: {v for b in seen for w, ls in zip(b.column("uid").to_pylist(), b.column("lists").to_pylist()) if w == u for v in ls} for u in (r.uid for r in x[:50])}
    assert all(of[j] in by[x[i].uid] for i in range(50) for j in np.argsort(-s[i])[:5])


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], y) for i, e, y in rows if good(e)]
    width = -(-max((len(e) for _, e, _ in kept), default=0) // parts)
    kept = [(i, e + [0] * (width * parts - len(e)), y) for i, e, y in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda e, p: e[p * width : (p + 1) * width]
    books = [[cut(e, p) for _, e, _ in first] for p in range(parts)]
    near = lambda q, b: min((sum((x - y) ** 2 for x, y in zip(q, c)), j) for j, c in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, e, _ in kept:
                groups.setdefault(near(cut(e, p), books[p])[1], []).append(cut(e, p))
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else b for j, b in enumerate(books[p])]
    coded = [(i, y, [near(cut(e, p), books[p]) for p in range(parts)]) for i, e, y in kept]
    total = Counter()
    for _, y, c in coded:
        total[y] += sum(d for d, _ in c)
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), total[y], hashlib.sha256(text.encode()).hexdigest()) for i, y, c in coded), key=str)


def coded(spark, df):
    codes, books = vectorcodes.compress(df)
    sums = {r.label: r.s for r in codes.groupBy("label").agg(F.sum("error").alias("s")).collect()}
    return sorted(((r.id, r.code, r.error, sums[r.label], vectorcodes.digest(books)) for r in codes.collect()), key=str)


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, 8).astype(float).tolist() if i % 3 else rng.normal(size=8).tolist(), int(i % 5) or None) for i in rng.permutation(400)]
    rows += [(7, rows[0][1], 3), (8, rows[1][1], 3)]  # repeated ids and vectors
    got = coded(spark, spark.createDataFrame(rows, VECTORS).repartition(5))
    assert got == brute_codes(rows)
    codes, books = vectorcodes.compress(spark.createDataFrame(rows, VECTORS))
    for r in vectorcodes.decode(codes, books).collect():
        assert r.approx == [x for p in range(4) for x in books[p][int(r.code[2 * p : 2 * p + 2], 16)].tolist()]


def test_vector_codes_defined_cases(spark):
    rows = [(3, [0.5, -0.5, 0.25, 0.1, 0.3], 1), (1, [0.5], None), (None, [0.1, 0.2], None), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan")], 1), (7, [float("-inf")], 2), (1, [0.5], None), (2, [], 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("clash")).withColumn("code", F.lit(1))
    assert coded(spark, df) == brute_codes(rows)
    assert coded(spark, df.limit(0)) == []
    assert [r[2] >= 0 for r in coded(spark, spark.createDataFrame([(1, [3e38, 1.0, 1.0, 1.0], 1), (2, [-3e38, 1.0, 1.0, 1.0], 1)], VECTORS))] == [True, True]


def test_tree_ties_go_to_the_lower_index():
    rng = np.random.default_rng(1)
    for big in (1, 1 << 26):
        points = rng.integers(-3, 4, (256, 5)) * big
        q = rng.integers(-4, 5, (3000, 5)) * big
        d = ((q[:, None].astype(object) - points[None]) ** 2).sum(2) if big > 1 else ((q[:, None] - points[None]) ** 2).sum(2)
        index, distance = vectorcodes.Tree(points).nearest(q)
        assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert vectorcodes.Tree(np.zeros((40, 3), np.int64)).nearest(np.ones((2, 3), np.int64))[0].tolist() == [0, 0]


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    common = ["the", "of", "and", "to", "in", "is"]
    return " ".join(common[rng.integers(6)] if rng.random() < 0.45 else "".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n)) + "."


def test_quality_counts_and_verdicts(spark):
    rng = np.random.default_rng(2)
    texts = [prose(int(rng.integers(60, 300)), k) for k in range(40)]
    shout = prose(120, 90).upper().replace(" ", "!! ")
    odd = [None, "", "   \n\t", "a", "one two", "é ü x |#|", "a b c a b c a b c\na b c\n a b c\na b c", "x\n\nx\n \nx", "one two three " * 60, shout, " | ".join(f"w{k}" for k in range(80)), "\x00 \x7f é  " * 3, "w" * 300_000 + " z"]
    docs = spark.createDataFrame([(i, t, "en" if i % 9 else None) for i, t in enumerate([*texts, *odd])], "doc_id bigint, text string, lang string").withColumn("kept", F.lit("clash")).withColumn("__n", F.lit(1))
    got = {r.doc_id: r for r in quality.assess(docs, keep=["doc_id", "kept", "lang"]).collect()}
    for i, t in enumerate([*texts, *odd]):
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_counts(t), (i, t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert all(got[i].kept for i in range(40) if i % 9)
    assert not got[40 + odd.index(shout)].kept and not got[40 + 8].kept and not got[40 + 10].kept
    assert quality.assess(docs.limit(0)).count() == 0 and "text" in quality.assess(docs.limit(0)).columns


def test_distance_is_jensen_shannon(spark):
    pairs = [([1.0, 0.0], [0.0, 3.0]), ([1.0, 1.0], [2.0, 2.0]), ([3.0, 1.0], [1.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(pairs, "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.distance(F.col("p"), F.col("q"))).collect()]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    for d, (p, q) in zip(got[:3], pairs):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(x + y) / 2 for x, y in zip(p, q)]
        assert abs(d - math.sqrt((kl(p, m) + kl(q, m)) / 2)) < 1e-12
    assert got[3] == 1.0


def test_matrix_pads():
    assert matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), 2, np.int64).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert matrix(pa.array([], pa.list_(pa.float64())), 3).shape == (0, 3)
