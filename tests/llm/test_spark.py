"""The operators over small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from morphlake.llm import common, graph, html, mixing_lm, ngramjoin, spm, substring, topk, toxicity, warc
from pyspark.sql import functions as F
from test_native import brute_lines, brute_overlaps

DOCS = "doc_id bigint, text string"


def words(n, salt=0):
    return [f"w{(k * 7919 + salt * 104729) % 100003}" for k in range(n)]


def clash(df):
    return df.withColumn("__id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("words", F.lit(None).cast("string"))


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (5, "http://c d\r\nX: y", ""), (4, "u", "é" * 200_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "same"), (1, "http://b", "same")]
    pages = clash(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html_ = next(h for i, _, h in rows if i == r.page_id)
        data = (html_ or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min(i for i, _, h in rows if (h or "") == (html_ or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert bytes(r.payload) == (data if r.page_id == first else b"")
    assert [r.page_id for r in warc.read_records(index.filter("page_id = 4")).collect()] == [4]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><h1>Title here</h1><p>Some long text, it is.</p></article><footer>&copy; x</footer>"), (2, None, None), (3, "u", "")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1]["__text"] == "Title here\nSome long text, it is." and got[2]["__text"] == got[3]["__text"] == "" and got[1].text == "clash"
    assert html.extract(pages.limit(0)).count() == 0


def test_top_k_table(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (7, [0.5, 0.25]), (8, [-0.1, 0.9]), (9, None), (10, [0.1, None]), (11, [0.1, float("nan")]), (12, [float("inf"), 0.0]), (13, [0.5]), (14, [])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.top_k(v, v.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    scaled = {i: [math.floor(256 * x) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    for q in (0, 50):
        s = sorted((-sum(a * b for a, b in zip(scaled[q], e)), i) for i, e in scaled.items() if i != q)[:5]
        assert [(i, -x) for x, i in s] == [(i, x) for _, i, x in got[q]]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def brute_classes(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_classes(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 4)
    base, rows = words(60), []
    for i in range(40):  # a family whose members drift away from the first
        base = list(base)
        base[(i * 7) % 60] = f"v{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(words(80, 3))) for i in range(6)] + [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "one"), (205, " \n"), (206, "x"), (300, " ".join(words(3000, 9))), (301, " ".join(words(2990, 9)))]
    docs = clash(spark.createDataFrame(rows, DOCS))
    want = brute_classes(rows, 4, 85)
    assert {r["__id"]: (r["__n"], r["__component"]) for r in ngramjoin.link_documents(docs).collect()} == want
    assert len({c for _, c in want.values()}) < len(rows) - 10
    assert ngramjoin.link_documents(docs.limit(0)).count() == 0
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 1)
    five = {r["__id"]: r["__component"] for r in ngramjoin.link_documents(docs, width=5, percent=80).collect()}
    assert five == {i: c for i, (_, c) in brute_classes(rows, 5, 80).items()}
    twice = docs.filter("doc_id = 100").unionAll(docs.filter("doc_id = 100")).unionAll(docs.filter("doc_id = 101").withColumn("doc_id", F.lit(None).cast("bigint")))
    assert [r["__component"] for r in ngramjoin.link_documents(twice).collect()] == [100] * 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_passages(spark):
    p = words(70, 1)
    fuzzy = [x if k % 25 else "other" for k, x in enumerate(p)]
    cut = p[:30] + p[33:]
    rows = [(1, " ".join(words(40, 2) + p)), (2, " ".join(p + words(90, 3))), (3, " ".join(words(10, 4) + fuzzy)), (4, " ".join(cut)), (5, " ".join(words(500, 5))), (6, None), (7, ""), (8, " ".join(words(100, 6)[:20] + p[:25])), (9, "a b"), (None, " ".join(p))]
    docs = clash(spark.createDataFrame(rows, DOCS))
    got = {(r.doc_id, r.other_id): r for r in substring.passages(docs).collect()}
    assert {i for pair in got for i in pair} == {1, 2, 3, 4}
    r = got[2, 1]
    assert (r.start_word, r.end_word, r.other_start, r.other_end, r.matched) == (0, 70, 40, 110, 70)
    assert substring.passages(docs.limit(0)).count() == 0
    assert substring.passages(docs.filter("doc_id = 1").unionAll(docs.filter("doc_id = 1"))).count() == 0


def test_passages_of_repeated_ids_and_long_texts(spark):
    p = words(70, 1)
    rows = [(1, " ".join(p + words(30, 2))), (1, " ".join(words(90, 3))), (2, " ".join(words(10, 4) + p)), (2, " ".join(words(10, 4) + p)), (3, " ".join(words(60_000, 5))), (4, " ".join(words(59_000, 5)) + " end")]
    runs = [sorted(map(tuple, substring.passages(spark.createDataFrame(rows, DOCS).repartition(n)).collect())) for n in (1, 7)]
    assert runs[0] == runs[1] and not {r for r in runs[0] if r[0] == r[1]}
    assert (4, 3, 0, 59_000, 0, 59_000, 59_000) in runs[0]


def test_two_passages_of_one_pair(spark):
    p, q = words(60, 11), words(60, 12)
    rows = [(1, " ".join(p + words(100, 13) + q)), (2, " ".join(words(40, 14) + p + words(100, 15) + q + words(40, 16)))]
    got = substring.passages(spark.createDataFrame(rows, DOCS)).orderBy("start_word").collect()
    assert [tuple(r)[:6] for r in got] == [(2, 1, 40, 100, 0, 60), (2, 1, 200, 260, 160, 220)]


def test_passages_whose_pieces_stand_first_elsewhere(spark):
    p = words(60, 21)
    rows = [(10, words(50, 22) + p[:30]), (11, p[30:] + words(50, 23)), (12, words(20, 24) + p), (13, p + words(20, 25))]
    r = random.Random(5)
    phrases = [words(r.choice((9, 20, 30, 45)), 30 + k) for k in range(30)]
    pieces = [sum(r.sample(phrases, 4), []) for _ in range(12)]
    rows += [(20 + k, sum((r.choice(pieces + phrases) + words(r.randint(0, 30), 100 + 3 * k + i) for i in range(3)), [])) for k in range(60)]
    got = defaultdict(list)
    for x in substring.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)).collect():
        got[x.doc_id].append(x)
    assert [(x.other_id, x.start_word, x.end_word, x.matched) for x in got[13]] == [(12, 0, 60, 60)]
    earlier, checked = set(), 0
    for i, w in rows:
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, run in enumerate(runs):
            if run in earlier:
                checked += 1
                assert any(min(x.end_word, k + 50) - max(x.start_word, k) >= 48 for x in got[i]), (i, k)
        earlier |= set(runs)
    assert checked > 100


def test_altered_passages_whose_pieces_stand_first_elsewhere(spark):
    p = words(60, 21)
    altered = [x if k not in (17, 29, 46) else f"other{k}" for k, x in enumerate(p)]
    rows = [(10, words(50, 22) + p[:30]), (11, p[30:] + words(50, 23)), (12, words(20, 24) + p), (13, altered + words(20, 25))]
    r = random.Random(6)
    phrases = [words(r.randint(20, 30), 40 + k) for k in range(12)]
    rows += [(100 + k, words(30, 60 + k) + x) for k, x in enumerate(phrases)]
    joined = [sum(r.sample(phrases, 3), []) for _ in range(8)]
    rows += [(200 + k, x + words(30, 80 + k)) for k, x in enumerate(joined)]
    rows += [(300 + k, words(30, 100 + k) + [w if i % 21 != 20 else f"new{k}" for i, w in enumerate(x)]) for k, x in enumerate(joined)]
    got = defaultdict(list)
    for x in substring.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)).collect():
        got[x.doc_id].append(x)
    assert [(x.other_id, x.start_word, x.end_word, x.other_start) for x in got[13]] == [(12, 0, 60, 20)]
    for k, x in enumerate(joined):
        whole = [y for y in got[300 + k] if y.other_id == 200 + k]
        assert whole and max(y.end_word - y.start_word for y in whole) >= len(x) - 6, k


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*")}


def test_passages_leave_no_shuffle_files(spark):
    p = words(60, 41)
    rows = [(k, " ".join(words(40, 300 + k) + (p if k % 2 else p[:25]) + words(40, 400 + k))) for k in range(40)]
    before = shuffle_files(spark)
    found = substring.passages(spark.createDataFrame(rows, DOCS))
    for _ in range(50):  # files are deleted a moment after the job
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert {r.doc_id for r in found.collect()} == set(range(3, 40, 2))


def test_surroundings_of_open_places():
    r = random.Random(3)
    rows = sorted({(i, p): (i, p, r.choice((i, 90 + p % 3)), r.randint(0, 4)) for i in range(6) for p in r.sample(range(400), 30)}.values())
    spans = sorted((i, a, None, a + r.randint(10, 90)) for i in range(6) for a in r.sample(range(400), 2))
    names = ["id", "pos", "other", "at"]
    mixed = pa.table(dict(zip(names, (pa.array(v, pa.int64()) for v in zip(*sorted(rows + spans, key=lambda x: x[:2]), strict=True)), strict=True)))
    places = pa.Table.from_batches(substring._open_places(iter(mixed.to_batches(max_chunksize=7))))
    free = [o != i and not any(i == j and a <= p and p + substring.K <= b for j, a, _, b in spans) for i, p, o, _ in rows]
    assert [tuple(x.values()) for x in places.to_pylist()] == [(*x, f) for x, f in zip(rows, free, strict=True)] and any(free)
    anchors = {x[2:] for x, f in zip(rows, free, strict=True) if f}
    marked = places.append_column("wanted", pa.array([x[2:] in anchors for x in rows]))
    got = {(x["id"], x["pos"]): x for x in pa.Table.from_batches(substring._surroundings(iter(marked.to_batches(max_chunksize=11)))).to_pylist()}
    firsts = set()
    for (i, p, *seed), f in zip(rows, free, strict=True):
        around = [tuple(s) for j, q, *s in rows if i == j and q != p and abs(q - p) <= substring.REACH]
        first = tuple(seed) in anchors and bool(around) and (i, *seed) not in firsts
        if first:
            firsts.add((i, *seed))
        assert ((i, p) in got) == (tuple(seed) in anchors and bool(around) and (f or first))
        if (i, p) in got:
            assert got[i, p]["open"] == f and len(set(got[i, p]["pairs"])) == len(got[i, p]["pairs"]) == len(set(around))


def test_surroundings_in_any_order_of_a_document():
    r = random.Random(4)
    rows = sorted({(i, p): (i, p, r.choice((i, 90 + p % 3)), r.randint(0, 4), r.random() < 0.5, r.random() < 0.8) for i in range(6) for p in r.sample(range(400), 30)}.values())
    names = ["id", "pos", "other", "at", "open", "wanted"]
    made = []
    for order in (rows, sorted(rows, key=lambda x: (x[0], r.random()))):
        places = pa.table(dict(zip(names, map(pa.array, zip(*order, strict=True)), strict=True)))
        made.append(sorted((*list(x.values())[:-1], sorted(x["pairs"])) for x in pa.Table.from_batches(substring._surroundings(iter(places.to_batches(max_chunksize=11)))).to_pylist()))
    assert made[0] and made[0] == made[1]


def test_anchors_are_grouped_by_hashing(spark):
    r = random.Random(5)
    rows = sorted({(seed, i): (seed, i, r.randint(0, 5000)) for i in range(-30, 30) for seed in r.sample(range(-45, 45), 20)}.values())
    want = {}
    for seed, i, pos in sorted(rows, key=lambda x: x[1]):
        want.setdefault(seed, []).append((i, pos))
    found = substring._anchors(spark.createDataFrame(rows + rows[:50], "seed long, id long, pos int").repartition(5))
    assert {tuple(x) for x in found.collect()} == {(seed, *v[0]) for seed, v in want.items() if len(v) > 1}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_whole_documents():
    r = random.Random(9)
    rows = sorted((r.randint(0, 12), r.randint(0, 2), k) for k in range(200))
    whole = pa.table(dict(zip("abk", (pa.array(v) for v in zip(*rows, strict=True)), strict=True)))
    for size in (1, 3, 50, 1000):
        parts = [t.to_pylist() for t in substring._whole_documents(iter(whole.to_batches(max_chunksize=size)), "a", "b")]
        assert sum(parts, []) == whole.to_pylist()
        groups = [{(x["a"], x["b"]) for x in part} for part in parts]
        assert sum(map(len, groups)) == len(set().union(*groups)) == len({x[:2] for x in rows})


def test_altered_copies_of_a_family(spark):
    """Passages of an altered family grow with it, and those of a brute-force comparison are found."""
    counts = {}
    for size in (20, 40):
        r = random.Random(size)
        p = words(60, 21)
        rows = [(10, words(50, 22) + p[:30]), (11, p[30:] + words(50, 23))]
        rows += [(20 + k, words(20, 100 + k) + [w if r.random() > 0.06 else f"new{k}x{i}" for i, w in enumerate(p)] + words(20, 200 + k)) for k in range(size)]
        rows += [(100 + k, words(30, 300 + k) + p[10:22] + words(30, 400 + k)) for k in range(size)]
        found = substring.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)).collect()
        counts[size] = len(found)
        # By brute force: family members with an earlier one that has as many equal words on a diagonal of LEAST words or more.
        alike = set()
        for i, w in rows:
            for j, v in rows:
                if j < i:
                    for d in range(-len(v), len(w)):
                        same = [w[k] == v[k - d] for k in range(max(0, d), min(len(w), len(v) + d))]
                        if any(sum(same[k : k + substring.LEAST]) >= substring.ALIKE * substring.LEAST for k in range(len(same) - substring.LEAST + 1)):
                            alike.add(i)
        got = {x.doc_id for x in found}
        assert len(got & alike) >= 0.9 * len(alike) and len(alike) >= size - 2, (len(got & alike), len(alike))
        assert not {i for i in got if i >= 100}
    assert counts[40] < 3 * counts[20], counts


def test_sentencepiece_table(spark):
    docs = clash(spark.createDataFrame([(1, "hello  world\n"), (2, None), (3, ""), (4, "z" * 5000)], DOCS))
    got = spm.encode_documents(docs, back="__back")
    assert {r.doc_id: r["__back"] for r in got.collect()} == {1: "hello  world\n", 2: "", 3: "", 4: "z" * 5000}
    again = spm.decode_documents(got.drop("__back"), name="__again")
    assert {r.doc_id: r["__again"] for r in again.collect()} == {1: "hello  world\n", 2: "", 3: "", 4: "z" * 5000}
    assert spm.encode_documents(docs.limit(0)).count() == 0


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "other text"), (None, "x"), (2, None), (3, "long " * 50_000)], DOCS)
    html_ = spark.createDataFrame([(1, "<nav><ul><li>Home</li></ul></nav><article><h1>Title here</h1><p>" + "Some words of text. " * 20_000 + "</p></article>")] * 2 + [(1, "<nav>x</nav>")], "page_id bigint, html string")
    got = html.extract(html_).collect()
    assert len(got) == 3 and len({r["__text"] for r in got}) == 2
    assert len(spm.encode_documents(docs).collect()) == 6
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (9, 1), (None, 1), (2, None)], "doc_id bigint, toxic int")
    net = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs.withColumn("__score", F.lit("clash")), net).collect()
    assert len(scored) == 6 and scored[0]["__score"] == scored[1]["__score"] and all(0 <= r["__score"] <= 1 for r in scored)
    assert toxicity.score_documents(docs.limit(0), net).count() == 0 and toxicity.fit(docs.limit(0), labels) is None
    codes, counts = mixing_lm.fit(docs, "doc_id", "text")
    rows = mixing_lm.score(docs, codes, counts).collect()
    twice = [r for r in rows if r["__n_tokens"] == 4]
    assert len(rows) == 6 and len(twice) == 2 and twice[0] == twice[1] and max(r["__n_tokens"] for r in rows) == 50_001
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in topk.top_k(v, v.filter("vec_id = 0")).collect()} == {(0, 1)}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter(~common.in_bucket("doc_id", 4, 2))
    net = toxicity.fit(docs, train)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "the " * 60_000)], DOCS)
    scored = {r.doc_id: r["__score"] for r in toxicity.score_documents(clash(docs.join(labels.filter(common.in_bucket("doc_id", 4, 2)), "doc_id", "left_semi").select("doc_id", "text").unionAll(extra)), net).collect()}
    assert scored[-1] == scored[-2] and all(0 <= s <= 1 for s in scored.values())
    held = [(r.toxic, scored[r.doc_id]) for r in labels.filter(common.in_bucket("doc_id", 4, 2)).collect()]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.93
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r["__score"] for r in toxicity.score_documents(docs.limit(3), None).collect()} == {0.0}


def test_language_model_counts_are_exact(spark):
    docs = clash(spark.createDataFrame([(i, f"The  w{i % 5} of w{i} the") for i in range(60)] + [(60, None), (61, ""), (62, "rare")], DOCS))
    train = docs.filter(~common.in_bucket("doc_id", 5, 1))
    codes, counts = mixing_lm.fit(train, "doc_id", "text")
    tokens = lambda t: (t or "").lower().split() + ["</s>"]
    c = Counter(w for r in train.collect() for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    assert (codes.n, codes.v) == (n, v)
    got = {r["__id"]: r for r in mixing_lm.score(docs, codes, counts).collect()}
    for r in docs.collect():
        own = tokens(r.text)
        x = got[r.doc_id]
        assert (x["__n_tokens"], x["__n_known"]) == (len(own), sum(w in c for w in own))
        assert x["__base"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert x["__spelled"] < 0 and x["__score"] < 0
    empty, none = mixing_lm.fit(docs.limit(0), "doc_id", "text")
    assert mixing_lm.score(docs, empty, none).count() == 63


def slow_bits(codes, text):
    """Bits of one text's words, and of its spelled bytes, symbol by symbol and bit by bit, with nothing but the model's parameters."""
    f = np.float32
    squash = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    hashes = {}

    def hashed(word):
        if word not in hashes:
            hashes[word] = int(common.word_hashes(pa.array([word]), lower=False)[0][0])
        return hashes[word]

    def mixed(x):
        return int(common.mix(np.array([x % (1 << 64)], np.uint64))[0]) >> 32

    tokens = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    tokens = [bytes(b + 32 if 65 <= b <= 90 else b for b in t) for t in tokens]
    symbols, last, previous = [], 0, 0
    where = {int(h): k for k, h in enumerate(codes.words)}
    for place, token in enumerate([*tokens, None]):
        h = int(mixing_lm.END) if token is None else hashed(token.decode())
        k = where.get(h, len(codes.words))
        symbols.append((int(codes.code[k]), int(codes.bits[k]), [0, last + (1 << 50), previous | 1], place // mixing_lm.BLOCK, 0))
        if k == len(codes.words) and token is not None:
            back = b""
            for b in [*token, 32]:
                at = lambda i: back[-i] if i <= len(back) else 0  # noqa: B023, E731
                near = at(2) << 8 | at(1)
                symbols.append((int(codes.byte_code[b]), int(codes.byte_bits[b]), [(1 << 60) + near, (1 << 60) + (at(3) << 16 | near | 1 << 50), (1 << 60) + (at(5) << 32 | at(4) << 24 | at(3) << 16 | near | 1 << 51)], place // mixing_lm.BLOCK, 1))
                back += bytes([b])
        if codes.frequent[k]:
            last = int(codes.frequent[k])
        previous = h
    own, total = [0.0] * 4, [0.0, 0.0]
    for block in sorted({s[3] for s in symbols}):
        errors, size = [0.0] * 4, 0
        for code, bits, contexts, own_block, letter in symbols:
            if own_block != block:
                continue
            contexts = [mixed(c) for c in contexts]
            for i in range(bits):
                node, bit = (code | 1 << bits) >> (bits - i), code >> (bits - i - 1) & 1
                x, gate = [], 0
                for c in range(3):
                    slot = (((node * int(mixing_lm._SEEDS[c])) % (1 << 32) ^ contexts[c]) * 0x27D4EB2F % (1 << 32)) >> (32 - mixing_lm.SLOTS[c])
                    found = int(codes.tables[c][slot])
                    x.append(found / 2048)
                    gate = gate * 4 + (found & 3)
                x.append(0.3)
                dot = sum((float(codes.weights[gate][j]) + own[j]) * x[j] for j in range(4))
                z = max(-7.99, min(7.99, dot)) * 2 + 16
                cell = int(z)
                at = cell + ((node > 255) + (node > 1 << 14)) * mixing_lm.APM
                low, high = float(codes.apm[at]), float(codes.apm[at + 1])
                p = max(1e-5, min(1 - 1e-5, 0.5 * (squash(dot) + low + (high - low) * (z - cell))))
                total[letter] += math.log2(p if bit else 1 - p)
                for j in range(4):
                    errors[j] += (bit - squash(dot)) * x[j]
                size += 1
        rate = float(f(mixing_lm.DOC_RATE / 8 / math.sqrt(16 + size)))
        own = [w * 0.98 + rate * e for w, e in zip(own, errors, strict=True)]
    return total


def test_language_model_equals_a_slow_version(spark):
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(words(40, 3)) for _ in range(n))
    docs = spark.createDataFrame([(i, some(r.randint(1, 150))) for i in range(60)] + [(100, None), (101, ""), (102, "Never SEEN wörds, " + some(120)), (103, "a" * 300)], DOCS)
    codes, counts = mixing_lm.fit(docs.filter("doc_id < 60"), "doc_id", "text")
    seen, known = {r["__h"] % (1 << 64): r["__c"] for r in counts.collect()}, {int(w) for w in codes.words}
    for x in docs.filter("doc_id > 55").collect():
        got = mixing_lm.score(docs.filter(F.col("doc_id") == x.doc_id), codes, counts).first()
        own, spelled = slow_bits(codes, x.text)
        assert got["__spelled"] == pytest.approx((own + spelled) * math.log10(2), rel=1e-3), x.doc_id
        tokens = [*(int(h) for h in common.word_hashes(pa.array([x.text or ""]))[0]), int(mixing_lm.END)]
        rare = [seen.get(t, 0) for t in tokens if t not in known]
        among = codes.n - int(codes.counts.sum()) + 0.5 * (codes.v - len(codes.words) + 1)
        assert got["__score"] == pytest.approx(own * math.log10(2) + sum(math.log10((c + 0.5) / among) for c in rare), rel=1e-3), x.doc_id


def test_language_model_tables_hold_all_training_documents(spark):
    rows = [(i, f"the cat {i % 3} sat on the mat {i}") for i in range(40)]
    codes, _ = mixing_lm.fit(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    sums = [np.zeros(2 << k, np.int64) for k in mixing_lm.SLOTS]
    mixing_lm.count_into(sums, pa.array([t for _, t in rows]), codes)
    assert all(a.any() and np.array_equal(a, b) for a, b in zip(codes.tables, mixing_lm.tables_of(sums), strict=True))
    assert not np.array_equal(codes.weights[0], np.full_like(codes.weights[0], 0.35))


def test_language_model_tunes_on_whole_texts(spark):
    fits = [mixing_lm.fit(spark.createDataFrame([(i, "the cat sat " * 2000 + end) for i in range(6)], DOCS), "doc_id", "text")[0] for end in ("on the mat", "zzzz " * 2000)]
    z, q = (ord(x) for x in "zq")
    assert fits[0].byte_bits[z] == fits[0].byte_bits[q] and fits[1].byte_bits[z] < fits[1].byte_bits[q]
    assert not np.array_equal(fits[0].weights, fits[1].weights)
    tuned = [n // mixing_lm.tuning_plan(n)[0] for n in (10, 400, 1000, 10**6, 10**8)]
    assert tuned == sorted(tuned) and tuned[-1] == 100 * tuned[-2] and tuned[0] == 10


def test_language_model_tunes_on_every_document(spark):
    assert all(mixing_lm.tuning_plan(n)[0] == 1 for n in (1, 400, 1300, 10**4, 10**8))
    for n in (1, 1199, 1200, 10**4, 10**8):  # a pass has a part of its own at any size, and a shard never grows
        _, parts, shards = mixing_lm.tuning_plan(n)
        assert parts == mixing_lm.PASSES and n / parts / shards < 2 * mixing_lm.TUNING
        assert shards == 1 or n / parts / shards >= mixing_lm.TUNING
    rows = [(None, f"the cat {i % 3} sat on the mat {i}") for i in range(1300)]
    codes, _ = mixing_lm.fit(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    assert np.isfinite(codes.weights).all() and not np.array_equal(codes.weights[0], np.full_like(codes.weights[0], 0.35))


def test_language_model_splits_a_row_that_is_repeated(spark):
    rows = [(7, "the same row stands here")] * 6000 + [(i, f"the cat {i % 3} sat on the mat {i}") for i in range(6000)]
    dealt = mixing_lm.dealt(spark.createDataFrame(rows, "__id bigint, __text string"), 3, 10)
    sizes = [x["count"] for x in dealt.groupBy("__part", "__shard").count().collect()]
    assert len(sizes) == 30 and sum(sizes) == 12000 and max(sizes) < 600


def test_language_model_tunes_a_unit_on_one_fold(spark):
    rows = spark.createDataFrame([(i, f"text {i}", i % mixing_lm.FOLDS) for i in range(6000)], "__id bigint, __text string, __fold int")
    for shards in (1, 4, 5, 13):
        got = mixing_lm.units(mixing_lm.dealt(rows, 3, shards), shards).groupBy("__part", "__unit").agg(F.count("*").alias("n"), F.countDistinct("__fold").alias("folds"), F.countDistinct("__shard").alias("shards")).collect()
        assert sum(r["n"] for r in got) == 6000 and len(got) == 3 * (shards if shards < mixing_lm.FOLDS else shards // mixing_lm.FOLDS * mixing_lm.FOLDS)
        assert all((r["folds"], r["shards"] == 1) == ((mixing_lm.FOLDS, True) if shards < mixing_lm.FOLDS else (1, False)) for r in got)
        assert max(r["n"] for r in got) < 2.5 * 6000 / 3 / shards


def test_language_model_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = [(i, f"the cat {i % 3} sat on the mat {i}") for i in range(40)]
    mixing_lm.fit(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    for _ in range(50):  # files are deleted a moment after the job
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


@pytest.mark.parametrize("share", [0, 0.001, 0.0625, 0.3, 1])
def test_counts_are_packed_without_loss(share):
    r = np.random.default_rng(4)
    piece = np.where(r.random(2 * mixing_lm.PIECE) < share, r.geometric(0.5, 2 * mixing_lm.PIECE), 0).astype(np.int32)
    some = np.flatnonzero(piece)[:4]
    piece[some] = [254, 255, 256, 2**31 - 1][: len(some)]
    total = np.arange(len(piece), dtype=np.int64)
    made = mixing_lm.packed(piece)
    mixing_lm.unpacked_into(total, *made)
    assert np.array_equal(total - np.arange(len(piece)), piece)
    assert sum(map(len, made)) <= min(len(piece) // 8, 2 * np.count_nonzero(piece)) + np.count_nonzero(piece) + 4 * len(some)


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(spark, folder, rows, items, labels):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """Stage by stage in plain Python; only the network's parameters come from the operator."""
    pipeline, library = pytest.importorskip("corpus_pipeline"), pytest.importorskip("sentencepiece")
    r = random.Random(11)
    plain, rude = words(60, 1), [f"vile{k}" for k in range(6)]
    rows = []
    for i in range(1, 241):
        own = [r.choice(plain) for _ in range(r.randint(20, 60))]
        if i % 5 == 0:
            for _ in range(6):
                own.insert(r.randrange(len(own)), r.choice(rude))
        lines = [" ".join(own[k : k + 8]) for k in range(0, len(own), 8)]
        if i % 7 == 0:
            lines = ["share this page", "with your friends", "and subscribe"] + lines
        rows.append((i, "\n".join(lines)))
    copy = rows[10][1]
    rows += [(300, copy), (301, copy + " end"), (302, copy), (303, "x"), (304, None), (305, ""), (306, " \n\n \n"), (307, "\n".join(f"row {k % 5}" for k in range(2000)))]
    items = [(1, " ".join(words(20, 77))), (2, " ".join(rows[20][1].split()[3:18])), (3, None)]
    rows.append((400, " ".join(words(30, 5) + words(20, 77))))
    labels = [(i, 1, int(i % 5 == 0)) for i, _ in rows if i <= 240 and i % 3]
    docs = corpus(spark, tmp_path, rows, items, labels)
    got = {x.doc_id: x for x in pipeline.run(spark, str(tmp_path)).collect()}

    net = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~common.in_bucket("doc_id", 4, 2)))
    kept = [(i, t) for i, t in rows if net.score(toxicity.words_of(pa.array([t], pa.string())))[0] < toxicity.THRESHOLD]
    assert 20 < len(rows) - len(kept) < 80
    cut = brute_lines(kept)
    kept = [(i, cut.get(i, t)) for i, t in kept if not t or cut[i]]  # a text goes if all its lines go
    classes = brute_classes(kept, 5, 80)
    kept = [(i, t) for i, t in kept if classes[i][1] == i]
    bad = {d for d, _ in brute_overlaps(kept, items)}
    kept = [(i, t) for i, t in kept if i not in bad]
    assert {21, 400} <= bad
    other = library.SentencePieceProcessor(model_file=spm.MODEL)
    assert {i: list(x.ids) for i, x in got.items()} == {i: other.encode(t or "") for i, t in kept}
    assert all(x.n_tokens == len(x.ids) and x.lang == "en" and x.source == "s" for x in got.values())


def test_pipeline_keeps_one_of_near_copies_of_repeated_and_null_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (words(60, k) for k in (1, 2, 3))
    near = lambda x, end: " ".join([*x, end])
    rows = [(2, near(a, "one")), (5, near(a, "two")), (5, near(b, "one")), (6, near(b, "two")), (None, near(c, "one")), (None, near(c, "two")), (None, near(a, "three")), (None, "alone"), (None, None), (None, ""), (7, None), (7, None), (5, near(b, "one"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).withColumn("__hash", F.lit("clash"))
    kept = [(x.doc_id, x.text) for x in pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    assert sum(x in kept for x in rows[4:6]) == 1
    assert sorted((x for x in kept if x not in rows[4:6]), key=str) == sorted([rows[0], rows[2], *rows[7:11]], key=str)


def test_pipeline_of_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("empty", "one"):
        docs = corpus(spark, tmp_path / name, [(1, "some words here and there")] * 3 if name == "one" else [], [], [])
        assert [x.doc_id for x in pipeline.run(spark, str(tmp_path / name)).collect()] == ([1] if name == "one" else [])
    named = docs
    for c in ("__score", "__n_lines", "__N_REMOVED", "__kept", "__text", "__ids", "__found", "__key", "n", "words", "item_id"):
        named = named.withColumn(c, F.lit(c))
    null = named.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("lang", F.lit(None).cast("string"))
    kept = named.unionAll(null).unionAll(named.withColumn("text", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("bigint")))
    for name, stage in pipeline.STAGES:
        before = kept.columns
        kept = common.stored(spark, stage(spark, kept, str(tmp_path / "one")), name)
        assert name == "sentencepiece" or (kept.columns == before and {x["__score"] for x in kept.collect()} == {"__score"}), name
    assert {(x.doc_id, x.n_tokens > 0) for x in kept.collect()} == {(1, True), (1, False)}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    p = words(40, 1)
    rows = [(1, " ".join(words(80, 2))), (2, " ".join(words(80, 2))), (3, "a\nb\nc\n" + " ".join(words(20, 3))), (4, "a\nb\nc\n" + " ".join(words(20, 4))), (5, " ".join(words(30, 5) + p)), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(p))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 3, 4, 6, 7]
    want = spm.encode(spm.read_model(), [" ".join(words(20, 4))])[0].tolist()
    assert got[4].ids == want and got[6].ids == [] and got[4].n_tokens == len(want)
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    assert kept.filter("doc_id = 4").first().n_chars == len(" ".join(words(20, 4)))
