"""Parts that need no Spark: hashing, search, chains, tokenizer, network, field, mixing model."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from morphlake.llm import common, html, mixing_lm, ngramjoin, spm, substring, topk, toxicity, warc

TEXTS = ["The  quick\tbrown\n", None, "", "   ", "é ü", "quick", "a" * 5000, "x y x y"]


def test_word_hashes_follow_words():
    hashes, splits = common.word_hashes(pa.array(TEXTS))
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("T", "t")) for t in TEXTS]
    assert np.diff(splits).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    by_word = {}
    for w, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_and_slices():
    words, splits = common.word_hashes(pa.array(["a b c d e", "a b", "", "b c d e", "a b"]))
    grams, ends = common.shingle_hashes(words, splits, 4)
    assert np.diff(ends).tolist() == [2, 1, 0, 1, 1]
    assert grams[1] == grams[3] and grams[2] == grams[4] and len(set(grams.tolist())) == 3
    batch = pa.RecordBatch.from_pydict({"t": ["aa", None, "b" * 10, "c"]})
    assert [x.num_rows for x in common.slices(batch, "t", 5)] == [2, 1, 1]


@pytest.mark.parametrize("seed", range(4))
def test_top_k_is_exact(seed):
    r = np.random.default_rng(seed)
    n, d = [(40, 3), (300, 8), (7, 2), (200, 4)][seed]
    v = r.integers(-50, 50, (n, d)).astype(float)
    if seed == 3:
        v[: n // 2] = v[0]  # many ties
    ids = r.permutation(n).astype(np.int64)
    rows, found, won = topk.block_top_k(ids, v, ids[:9], v[:9])
    for q in range(min(9, n)):
        s = v @ v[q]
        best = sorted((-int(s[i]), int(ids[i])) for i in range(n) if ids[i] != ids[q])[:5]
        assert [(-int(w), int(f)) for w, f in zip(won[rows == q], found[rows == q])] == best


def test_top_k_of_huge_numbers():
    v = np.array([[2.0**60, 1], [2.0**60, 2], [-(2.0**61), 5], [3, 3], [2.0**27, 0], [1, 0], [2, 0]])
    ids = np.arange(len(v))
    rows, found, won = topk.block_top_k(ids, v, ids[3:5], v[3:5])
    for q in (3, 4):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v[q], v[i])), i) for i in range(len(v)) if i != q)[:5]
        assert [(-min(max(-s, -(2**63)), 2**63 - 1), i) for s, i in scores] == [(-int(w), int(f)) for w, f in zip(won[rows == q - 3], found[rows == q - 3])]


def test_top_k_of_clusters_stops_early():
    r = np.random.default_rng(5)
    v = np.floor(256 * np.repeat(np.eye(8), 100, axis=0) + r.normal(0, 4, (800, 8)))
    ids = np.arange(800)
    rows, found, won = topk.block_top_k(ids, v, ids[:3], v[:3])
    assert won[rows == 0].tolist() == sorted((v @ v[0])[1:].astype(int).tolist(), reverse=True)[:5]


def test_warc_records():
    data = warc.record_bytes(7, "http://x/a b\r\n", b"<p>\r\n\r\n</p>", "A" * 32, "revisit", 3, 11)
    got = warc.parse_record(data)
    assert (got["page_id"], got["refers_to"], got["payload_bytes"], got["record_type"], got["payload"]) == (7, 3, 11, "revisit", b"")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(warc.record_bytes(1, None, b"x", "A" * 32, "response", None, 1))


def brute_chain(x, y):
    """Best score of a chain of k-mer matches taken one by one, by the same costs."""
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    best = 0.0
    f = {}
    for i in order:
        f[i] = substring.K + max([0.0] + [f[j] - substring.GAP * (x[i] - x[j] - substring.K + y[i] - y[j] - substring.K) for j in f if x[j] + substring.K <= x[i] and y[j] + substring.K <= y[i]])
        best = max(best, f[i])
    return best


def test_chains_match_brute_force():
    r = random.Random(3)
    for _ in range(60):
        picks = sorted({(r.randrange(40) * 30, r.randrange(40) * 30 + r.randrange(3)) for _ in range(r.randint(1, 12))})
        x, y = np.array([p[0] for p in picks]), np.array([p[1] for p in picks])
        chain, _ = substring.chains(x, y)[0]
        score = sum(n for *_, n in chain) - sum(substring.GAP * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2]) for a, b in zip(chain, chain[1:]))
        assert score == pytest.approx(brute_chain(x.tolist(), y.tolist()))


def test_a_chain_that_fails_is_split():
    r = np.random.default_rng(4)
    p, q = (r.integers(0, 1 << 16, 60).astype(np.uint16) for _ in range(2))
    for m, k in ((100, 100), (300, 300), (90, 140)):
        a, b = (np.concatenate([p, r.integers(0, 1 << 16, w).astype(np.uint16), q]) for w in (m, k))
        got = substring.align(a, b, 0, 0, [(3, 3, 50), (60 + m, 60 + k, 57)])
        assert len(got) == 2 and all(x1 - x0 in range(60, 66) and matched >= 60 for x0, x1, _, _, matched in got)
    # a stray seed far off spoils nothing, and what fails on its own is no passage
    a, b = (np.concatenate([p, r.integers(0, 1 << 16, 40).astype(np.uint16), q[:6], r.integers(0, 1 << 16, 20).astype(np.uint16)]) for _ in range(2))
    assert [x[:2] for x in substring.align(a, b, 0, 0, [(0, 0, 60), (100, 100, 6)])] == [(0, 60)]


@pytest.mark.parametrize("bits", [substring.BITS, 16])
def test_gaps_of_any_length_are_aligned(bits, monkeypatch):
    monkeypatch.setattr(substring, "BITS", bits)
    r = np.random.default_rng(8)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for u in a:
            before = 0
            for j, v in enumerate(b, 1):
                now = row[j]
                row[j] = before + 1 if u == v else max(row[j], row[j - 1])
                before = now
        return row[-1]

    for m, n, kinds in ((0, 5, 3), (1, 1, 1), (7, 9, 3), (64, 64, 5), (65, 40, 4), (200, 150, 20), (130, 300, 1000)):
        for _ in range(5):
            u, v = (r.integers(0, kinds, w).astype(np.uint16) for w in (m, n))
            assert substring._gap_matches(u, v) == brute(u.tolist(), v.tolist())
    # a copy with one more word, whose middle has no seeds of this pair; and a shift inside a gap of equal length
    a = r.integers(0, 1 << 16, 600).astype(np.uint16)
    b = np.insert(a, 300, 7)
    assert substring.align(b, a, 0, 0, [(0, 0, 200), (401, 400, 200)]) == [(0, 601, 0, 600, 600)]
    b = np.delete(b, 399)
    assert substring.align(b, a, 0, 0, [(0, 0, 100), (500, 500, 100)]) == [(0, 600, 0, 600, 599)]


def test_minimizers_cover_every_window():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 60, 500).astype(np.uint64)
    splits = np.array([0, 0, 5, 200, 500])
    got = set(substring.minimizers(hashes, splits, np.diff(splits)).tolist())
    for a, b in zip(splits[:-1], splits[1:]):
        for k in range(a, max(a + 1, b - substring.W + 1)):
            if a < b:
                window = range(k, min(b, k + substring.W))
                assert min(window, key=lambda i: (hashes[i], i)) in got
    assert len(got) < 200


def brute_viterbi(scores, word, floor):
    best = {0: (0.0, [])}
    for e in range(1, len(word) + 1):
        best[e] = max(((best[s][0] + (scores[word[s:e]] if word[s:e] in scores else floor if e - s == 1 else -1e18), best[s][1] + [word[s:e]]) for s in range(e)), key=lambda t: t[0])
    return best[len(word)][1]


def test_viterbi_on_a_unigram_model():
    r = random.Random(1)
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    texts = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(40)} | {"▁", "▁a"}
    pieces += [(t, -r.random() * 9, 1) for t in sorted(texts)]
    model = spm.make_model(pieces, spm.UNIGRAM)
    scores = {t: s for t, s, k in pieces if k == 1}
    floor = min(scores.values()) - spm.UNKNOWN_PENALTY
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(200)]
    ids, splits = spm.encode(model, words)
    for i, w in enumerate(words):
        got = [pieces[k][0] for k in ids[splits[i] : splits[i + 1]]]
        want = [p if p in scores else "".join(f"<0x{b:02X}>" for b in p.encode()) for p in brute_viterbi(scores, "▁" + w, floor)]
        assert sum(scores.get(p, floor) for p in got if not p.startswith("<0x")) == pytest.approx(sum(scores.get(p, floor) for p in want if not p.startswith("<0x")))
        assert spm.decode(model, ids[splits[i] : splits[i + 1]], np.array([0, splits[i + 1] - splits[i]])) == [w]


def test_byte_pairs_equal_the_library():
    library = pytest.importorskip("sentencepiece")
    model = spm.read_model()
    other = library.SentencePieceProcessor(model_file=spm.MODEL)
    r = random.Random(2)
    texts = ["", None, " ", "  two  blanks ", "line\nline\ttab", "日本語 🙂 é", "<s> ▁x", "ab" * 900, "x" * 500 + " " + "é" * 300, "\x00\x01", *("".join(r.choice("the and of ion\n.,é") for _ in range(r.randint(1, 200))) for _ in range(100))]
    ids, splits = spm.encode(model, texts)
    back = spm.decode(model, ids, splits)
    for i, t in enumerate(texts):
        assert ids[splits[i] : splits[i + 1]].tolist() == other.encode(t or "")
        assert back[i] == (t or "").replace("▁", " ")


def test_network_gradients():
    words = toxicity.words_of(pa.array(["bad one two", "two three bad four", ""]))
    net = toxicity.Network(words.kinds)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, which = net.rows(words.kinds), np.append(words.which, len(words.kinds))
    start, length, target = words.splits[:-1], np.diff(words.splits), np.array([1.0, 0.0, 1.0])
    net.chance = type("Never", (), {"random": staticmethod(lambda n: np.ones(n))})()

    def loss():
        gates, mask, used = toxicity._training_gates(net, words, rows, which, start, length)
        logits, cache = net.forward(gates.astype(np.float64), mask.astype(np.float64), keep=True)
        return np.logaddexp(0, logits).sum() - (target * logits).sum(), logits, cache, used

    _, logits, cache, used = loss()
    g, dgates = net.backward(cache, 1 / (1 + np.exp(-logits)) - target)
    g |= toxicity._input_gradients(net, used, dgates)
    r = np.random.default_rng(0)
    for name in ("w", "b", "u", "a", "v", "o", "c", "word"):
        p = net.p[name]
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in p.shape)
            if name == "word" and at[0] == 0:
                continue
            old = p[at]
            p[at] = old + 1e-3
            up = loss()[0]
            p[at] = old - 1e-3
            down = loss()[0]
            p[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3), name


def test_windows_cover_all_words():
    splits = np.array([0, 0, 10, 10 + 64, 74 + 65, 139 + 1000])
    text, start, length = toxicity.windows_of(splits)
    for i in range(len(splits) - 1):
        seen = {w for t, s, n in zip(text, start, length) if t == i for w in range(s, s + n)}
        assert seen == set(range(splits[i], splits[i + 1])) and (text == i).any()


def test_field_decodes_the_best_path():
    r = np.random.default_rng(4)
    field = html.Field()
    field.t, field.s = r.normal(size=(2, 2)), r.normal(size=2)
    sizes = np.array([3, 0, 1, 6])
    e = r.normal(size=(10, 2))
    got, at = field.decode(e, sizes), 0
    for n in sizes:
        own = e[at : at + n]
        score = lambda y: (field.s[y[0]] if n else 0) + sum(own[k, y[k]] for k in range(n)) + sum(field.t[y[k], y[k + 1]] for k in range(n - 1))  # noqa: B023, E731
        paths = [[b >> k & 1 for k in range(n)] for b in range(1 << n)]
        if n:
            assert got[at : at + n].tolist() == max(paths, key=score)
        at += n


@pytest.fixture(scope="module")
def field():
    return html.train(html.labelled_pages())


def test_extraction_on_held_out_layouts(field):
    right = total = 0
    for features, labels in html.labelled_pages(150, seed=77):
        got = field.decode(field.emissions(features), np.array([len(features)]))
        right, total = right + (got == labels).sum(), total + len(labels)
    assert right / total > 0.985


def test_extraction_cases(field):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Head &amp; tail</h1><p><b>One\n two.<br><p>a &lt; b &eacute;.</p><script>if (a<b) {}</script><p>Long words here go on and on.</p></article><section class='comments'><h3>Comments</h3><p>Nice post, I say.</p></section><footer>&copy; us</footer>"
    got = html.extract_texts(field, [page, None, "", "<p", "plain text only here.", "<p>" * 3000 + "deep"])
    assert got[0] == "Head & tail\nOne two.\na < b é.\nLong words here go on and on."
    assert got[1:3] == ["", ""] and len(got) == 6


def test_text_that_stands_in_for_something_is_kept_where_the_article_is(field):
    long = ["Words of the first part go on and on, as they do.", "The second part has a sentence. And another one.", "At last it ends here, with some more words."]
    menu, foot = "<noscript><p>Please turn scripts on.</p></noscript><nav><ul><li><a href='/a'>Home</a></li></ul></nav>", "<footer>&copy; us</footer>"
    for kind in ("noscript", "object", "canvas", "template", "iframe", "svg"):
        pages = [f"{menu}<article><h1>Head</h1><p>{long[0]}</p><{kind} x='y'><p>{long[1]}</p></{kind}><p>{long[2]}</p></article>{foot}"]
        pages.append(f"{menu}<article><h1>Head</h1><p>{long[0]}<{kind}><p>{long[1]}</{kind}><p>{long[2]}</article>{foot}")
        assert html.extract_texts(field, pages) == ["\n".join(["Head", *long])] * 2, kind
    cases = {"<p>a<svg><path d='x'></path></svg>b": ["ab"], "<p>a<noscript>b</noscript>c": ["a", "b", "c"], "<p>a<object><p>b</object>c<p>d": ["a", "b", "c", "d"], "<iframe>a": ["a"], "<title>a</title>b": ["b"]}
    assert {k: [t for t, _ in html.blocks_of(k)] for k in cases} == cases


def test_broken_pages_are_read_in_time_that_follows_their_length(field):
    makers = [lambda n: "<a " * n, lambda n: "<div>" * n + "</section>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<a \"'>" * n, lambda n: "<!--" * n, lambda n: "<script " * n + ">", lambda n: "<li>" * n, lambda n: "<p " + "x=' " * n + ">"]
    for make in makers:
        began = time.process_time()
        html.blocks_of(make(100_000))
        assert time.process_time() - began < 8, make(2)
    cases = {"a<script>x > y": ["a"], "a<!-- b > c": ["a"], "a <b": ["a <b"], "<p>a<svg/>b": ["ab"], "<p>a<script>b</script>c": ["ac"], "<p>a<script>b<br/>c": ["a"], "<div>a<i>b</div>c</i>d": ["ab", "cd"], "a <!-- b --> c <!-- d": ["a c"]}
    assert {k: [t for t, _ in html.blocks_of(k)] for k in cases} == cases


def test_pieces_hold_as_many_rows_as_asked():
    texts = ["a" * n for n in [10] * 50 + [400] * 33 + [3000] * 3]
    batch = pa.record_batch([pa.array(texts)], names=["t"])
    pieces = [p.column("t").to_pylist() for p in common.slices(batch, "t", 1000, 8, 20_000)]
    assert sum(pieces, []) == texts and min(map(len, pieces)) >= 8
    assert all(sum(map(len, p)) <= 1000 or len(p) < 16 for p in pieces)
    assert [len(p) for p in common.slices(batch.slice(83), "t", 1000, 8, 6000)] == [2, 1]
    assert [len(p) for p in common.slices(batch.slice(50), "t", 1000)] == [2] * 16 + [1] * 4


def test_mixing_model_learns_and_sums_to_one():
    r = random.Random(9)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(r.choice(words[:10] if i % 2 else words[10:20]) for _ in range(60)) for i in range(60)]
    h, _ = common.word_hashes(pa.array(texts))
    kinds, counts = np.unique(np.append(h, np.full(len(texts), mixing_lm.END, np.uint64)), return_counts=True)
    codes = mixing_lm.make_codes(kinds, counts, int(counts.sum()), len(kinds))
    assert (2.0 ** -codes.bits).sum() <= 1
    sums = [np.zeros(2 << k, np.int64) for k in mixing_lm.SLOTS]
    mixing_lm.count_into(sums, pa.array(texts[:50]), codes)
    codes.tables = mixing_lm.tables_of(sums)
    mixing_lm.tune(codes, pa.array(texts[40:50]))
    _, s = mixing_lm.tokens_of(pa.array(texts[50:]), codes)
    own = mixing_lm._walk(codes, s, 10, False).sum(axis=1)
    assert own.mean() > -60 * np.log2(20) * 0.95  # language of a document is seen
    t, s = mixing_lm.tokens_of(pa.array([None, "", "w1", "unseen word"]), codes)
    assert np.diff(t.splits).tolist() == [1, 1, 2, 3]
    scores = mixing_lm._walk(codes, s, 4, False).sum(axis=1)
    assert scores[0] == scores[1] and (scores < 0).all()
    # the probabilities of all words and spelled words after nothing do not exceed one
    texts = [f"w{k}" for k in range(50)]
    _, s = mixing_lm.tokens_of(pa.array(texts), codes)
    assert (2.0 ** mixing_lm._walk(codes, s, 50, False).sum(axis=1)).sum() < 1


def test_signature_trees_lose_no_pair():
    r = np.random.default_rng(6)
    base = [r.integers(0, 1 << 62, 80).astype(np.uint64) for _ in range(5)]
    sets = []
    for k in range(120):
        x = base[k % 5].copy()
        x[: r.integers(0, 20)] = r.integers(0, 1 << 62, 1)[0]
        sets.append(np.unique(x))
    sizes = np.array([len(x) for x in sets])
    bits = np.stack([np.frombuffer(ngramjoin.bitmap(x), np.uint64) for x in sets])
    classes = np.arange(120)
    rows = np.arange(120)
    got = {tuple(sorted(p)) for p in ngramjoin.similar_pairs(sizes, bits, classes, rows, rows, 85).tolist()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if ngramjoin.similar(sets[i], sets[j], 85)}
    assert want and want <= got and len(got) < 120 * 119 // 2


def test_a_task_of_empty_texts_only_is_counted():
    """The end of a text is spelled while ends are rare; a part that holds no word then has no byte to look at."""
    kinds = np.array([1, int(mixing_lm.END)], np.uint64)
    order = np.argsort(kinds)
    codes = mixing_lm.make_codes(kinds[order], np.array([3, 1])[order], 4, 2)
    also = np.append(codes.counts < mixing_lm.SPELLED, False)
    tokens, s = mixing_lm.tokens_of(pa.array([None, ""]), codes, also)
    assert list(s.letter) == [False, True, False, True] and len(s.code) == 4


def test_minimizers_of_texts_equal_those_of_windows():
    r = np.random.default_rng(7)
    for _ in range(100):
        size = r.choice([0, 1, 3, 11, 12, 13, 40], int(r.integers(0, 10)))
        splits = np.append(0, np.cumsum(size)).astype(np.int64)
        h = r.integers(0, int(r.choice([3, 1 << 60])), int(splits[-1])).astype(np.uint64)
        for width in (1, 3, 12):
            want = set()
            for a, b in zip(splits[:-1].tolist(), splits[1:].tolist(), strict=True):
                want |= {i + int(h[i : min(i + width, b)].argmin()) for i in range(a, max(b - width + 1, min(a + 1, b)))}
            assert substring.minimizers(h, splits, size, width).tolist() == sorted(want)


def test_chains_of_one_segment_are_laid_together_as_one_by_one():
    r = np.random.default_rng(8)
    rows = []
    for _ in range(2000):
        x, y, n = (int(v) for v in r.integers((0, 0, 6), (49, 49, 80)))
        a, b = (r.integers(0, 1000, m).astype(np.uint32) for m in (x + n + int(r.integers(0, 49)), y + n + int(r.integers(0, 49))))
        b[y : y + n] = a[x : x + n]
        m = min(x, y)
        b[y - m : y] = np.where(r.random(m) < 0.7, a[x - m : x], b[y - m : y])
        m = min(len(a) - x, len(b) - y) - n
        b[y + n : y + n + m] = np.where(r.random(m) < 0.7, a[x + n : x + n + m], b[y + n : y + n + m])
        rows.append((a, b, x, y, n))
    columns = [pa.array([v[k].tobytes() for v in rows], pa.binary()) for k in (0, 1)]
    alike, *spans = substring._single(*columns, *(np.array([v[k] for v in rows]) for k in (2, 3, 4)))
    assert alike.any() and not alike.all()
    for whole, span, (a, b, x, y, n) in zip(alike, zip(*(v.tolist() for v in spans), strict=True), rows, strict=True):
        if whole:
            assert substring.align(a, b, 0, 0, [(x, y, n)]) == ([span] if span[1] - span[0] >= substring.LEAST else [])


def test_pairs_of_one_segment_are_chained_together_as_one_by_one():
    r = np.random.default_rng(9)
    pairs = []
    for _ in range(500):
        x = np.unique(r.integers(0, 60, int(r.integers(1, 12))))
        y = x + (0 if r.random() < 0.7 else r.integers(0, 3, len(x)))
        pairs.append((x, y, r.choice([substring.K, substring.LONG], len(x), p=[0.8, 0.2])))
    edges = np.append(0, np.cumsum([len(v[0]) for v in pairs]))
    alone, segment, seeds = substring._only_segments(*(np.concatenate([v[k] for v in pairs]) for k in range(3)), edges)
    assert alone.any() and not alone.all()
    for one, found, total, v in zip(alone, segment.tolist(), seeds.tolist(), pairs, strict=True):
        made = substring.chains(*v)
        assert not one or made == [([tuple(found)], total)]


def test_first_of_equal_seeds_of_each_text():
    r = np.random.default_rng(11)
    for n in (0, 1, 7, 400):
        text, seeds = np.sort(r.integers(0, 6, n)), r.choice(r.integers(0, 1 << 63, 20).astype(np.uint64), n)
        first = {}
        for i, key in enumerate(zip(text.tolist(), seeds.tolist(), strict=True)):
            first.setdefault(key, i)
        assert substring.first_in_text(text, seeds).tolist() == sorted(first.values())


def test_a_shard_learns_from_texts_of_like_length_together():
    r = np.random.default_rng(10)
    texts = ["w " * int(n) for n in r.permutation([*[100] * 1000, *[4000] * 10])]
    rows = pa.table({"__fold": pa.array([0] * 1010), "__id": pa.array(range(1010)), "__text": pa.array(texts)})
    ordered = mixing_lm.by_length(rows)
    sizes = [len(t) for t in ordered.column("__text").to_pylist()]
    assert sorted(ordered.column("__id").to_pylist()) == list(range(1010)) and sizes == sorted(sizes)
    steps = lambda t: sum(-(-max(map(len, p.column("__text").to_pylist())) // (2 * mixing_lm.BLOCK)) for b in t.combine_chunks().to_batches() for p in common.slices(b, "__text", mixing_lm.TUNED))
    assert steps(ordered) < 0.7 * steps(rows)
