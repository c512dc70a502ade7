"""Line dedup and decontamination against plain Python, with nulls, ties and clashing columns."""

import random
from itertools import combinations

from morphlake.llm import decontaminate, linededup
from pyspark.sql import functions as F


def brute_lines(rows):
    """(id, text) -> text, as rows come in order of id."""
    seen, out = {}, {}
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not "".join(w).strip():
                continue
            if seen.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark):
    long = "\n".join(f"line {k % 7}" for k in range(3000))
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc\nd\ne"), (4, None), (5, ""), (6, "a\nb"), (7, "\n\r\n\n \t\n"), (11, "\n\r\n\n \t\n"), (8, "\n\n\n\n"), (9, "q\nq\nq\nq\nq"), (10, long), (None, "n\na\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__pos", F.lit(1)).withColumn("n_lines", F.lit("clash"))
    for name in ("__key", "__lines", "__kept", "__starts"):
        docs = docs.withColumn(name, F.lit(name))
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in got.items() if i != 4} == want and got[4].text is None
    assert got[3]["__n_removed"] == 4 and got[3]["__n_lines"] == 5 and got[1].n_lines == "clash" and got[1]["__kept"] == "__kept" and got[1]["__starts"] == "__starts"
    assert {r["__n_removed"] for r in linededup.dedup_lines(docs.withColumn("__n_removed", F.lit("old"))).collect()} >= {0, 4}
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    # a repeated row is one occurrence
    assert {r.text for r in linededup.dedup_lines(docs.filter("doc_id = 1").unionAll(docs.filter("doc_id = 1"))).collect()} == {"a\nb\nc\nd"}


def words(n, salt=0):
    return [f"w{(k * 7919 + salt * 104729) % 100003}" for k in range(n)]


def brute_overlaps(docs, items):
    """By every diagonal, without seeds."""
    out = set()
    for d, text in docs:
        a = (text or "").lower().split()
        for i, item in items:
            b = (item or "").lower().split()
            n = min(decontaminate.OVERLAP, len(b))
            allowed = n * decontaminate.SUBSTITUTIONS // decontaminate.OVERLAP
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(len(b))]
                if n and any(sum(same[k : k + n]) >= n - allowed for k in range(len(b) - n + 1)):
                    out.add((d, i))
    return out


def test_masks_miss_no_window():
    for n in range(1, decontaminate.OVERLAP + 1):
        masks = decontaminate.MASKS if n >= decontaminate.SPAN else decontaminate.SHORT[n]
        for unlike in combinations(range(n), n * decontaminate.SUBSTITUTIONS // decontaminate.OVERLAP):
            assert any(not {k + o for o in mask} & set(unlike) for mask in masks for k in range(n - mask[-1])), (n, unlike)


def test_decontamination_of_random_texts(spark):
    r = random.Random(4)
    some = lambda n: [f"t{r.randrange(60)}" for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 20, 30])]
    docs = []
    for k in range(80):
        own = list(r.choice(items)[1].split())
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = "other"
        docs.append((k, " ".join(some(r.randint(0, 12)) + own[r.randint(0, 1) :] + some(r.randint(0, 12)))))
    want = brute_overlaps(docs, items)
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x["__id"], x["__item"]) for x in got} == want and len(got) == len(want) and len({i for _, i in want}) > 10


def test_decontamination(spark):
    item, short = words(30, 1), words(9, 2)
    swapped = [x if k % 6 else "other" for k, x in enumerate(item)]
    far = [x if k % 2 else "other" for k, x in enumerate(item)]
    docs = [(1, " ".join(words(50, 3) + item + words(20, 4))), (2, " ".join(words(10, 5) + swapped)), (3, " ".join(far)), (4, None), (5, ""), (6, "  \t\n"), (7, " ".join(words(4000, 6))), (8, " ".join(short).upper()), (9, " ".join(item[:8])), (10, "one two")]
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, "two words"), (4, None), (5, "one two"), (6, " "), (1, " ".join(item))]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("__w", F.lit(0)).withColumn("item_id", F.lit(9))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))
    got = {(r["__id"], r["__item"]): r for r in decontaminate.overlaps(a, b).collect()}
    assert set(got) == brute_overlaps(docs, items) == {(1, 1), (2, 1), (8, 2), (10, 5)}
    assert got[1, 1]["__start"] == 50 and got[1, 1]["__agree"] == 13
    assert sorted(r.doc_id for r in decontaminate.clean(a, b).collect()) == [3, 4, 5, 6, 7, 9]
    named = a.withColumn("__found", F.lit(1)).withColumn("__KEY", F.lit(2))
    assert sorted(r.doc_id for r in decontaminate.clean(named, b).collect()) == [3, 4, 5, 6, 7, 9]
    assert decontaminate.overlaps(a.limit(0), b).count() == 0 and decontaminate.overlaps(a, b.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    item = words(20)
    a = spark.createDataFrame([(1, " ".join(item)), (2, "none of it at all here to see now")], "doc_id bigint, text string")
    b = spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string")
    assert [(r["__id"], r["__item"]) for r in decontaminate.overlaps(a, b).collect()] == [(1, 5)]
