"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is cut into words (runs of letters, digits and bytes beyond ASCII, A-Z folded), and the
words into overlapping windows. A word's input is a learnt vector of the word, if the training
sample knows it well, beside the mean of learnt vectors of its runs of three bytes (hashed, with
marks at both ends), which carry over to unseen words of like spelling. A forward and a backward gated
recurrent layer read the window, attention pools their states, a logistic unit scores them. A
text's score is that of its highest window. Training is numpy in one task, from all windows of a
bounded sample of labelled rows; a text's label stands for its highest window only.

Defined cases: a null text is empty; a text without words has one empty window. Null labels and
labels of unknown documents are left out; several labels of one document count as their
maximum. Of rows that repeat a sampled id, one is trained on (the one whose text has the largest
hash); all are scored. Without labels of both kinds the model is untrained and scores 0. Extra
columns pass through in `score_documents`; one with the name of the result gives way to it. Every word of every text is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm import common
from morphlake.llm.common import bounded_batches, in_bucket, slices, table

#: Labelled rows of each kind that the model is fitted on, at most.
TRAIN_ROWS = 1500
WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIM, CHAR_DIM, QUERY_DIM = 8, 8, 12, 8
#: Vectors of hashed runs of three bytes.
CHAR_ROWS = 1 << 13
#: A word gets a vector of its own from so many sampled windows on.
LEAST_WINDOWS = 25
#: Passes over the sample; more where it is so small that STEPS updates would not be reached.
EPOCHS, STEPS, BATCH, RATE, SLOWER, DECAY, DROPPED = 8, 320, 96, 0.015, 0.75, 3e-5, 0.3
THRESHOLD = 0.3
#: Windows that go through the network at once when scoring.
SCORE_BATCH = 512

_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Words:
    """Words of several texts: hash of each, range of each text, and bytes of each distinct word."""

    kinds: np.ndarray  # hash of each distinct word
    which: np.ndarray  # index into kinds, of each word
    splits: np.ndarray
    grams: np.ndarray  # row of each run of three bytes, of all distinct words
    ends: np.ndarray  # the range of grams of each distinct word, kinds + 1


def words_of(texts: pa.Array) -> Words:
    raw, offsets = common.buffer_of(texts)
    raw = common._LOWER[raw]
    blank = np.where(_SPLIT[raw], np.uint8(32), raw)
    starts, ends, splits = common.word_spans(blank, offsets)
    hashes = common.span_hashes(blank, starts, ends)
    kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    length = ends[first] - starts[first]
    bounds = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(length, out=bounds[1:])
    k = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
    at = k + np.repeat(starts[first], length)
    here = blank[at].astype(np.uint32)
    before = np.where(k > 0, blank[np.maximum(at - 1, 0)], np.uint8(1)).astype(np.uint32)
    after = np.where(k + 1 < np.repeat(length, length), blank[np.minimum(at + 1, max(len(blank) - 1, 0))], np.uint8(2)).astype(np.uint32)
    grams = ((before << 16 | here << 8 | after) * np.uint32(2654435761)) >> np.uint32(32 - CHAR_ROWS.bit_length() + 1)
    return Words(kinds, which, splits, grams.astype(np.int64), bounds)


def _means(table_: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) < 2:
        return np.zeros((0, table_.shape[1]), np.float32)
    return np.add.reduceat(table_[grams], bounds[:-1], axis=0) / np.diff(bounds)[:, None].astype(np.float32)


def windows_of(splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window; a text has one at least."""
    counts = np.diff(splits)
    made = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), made)
    k = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    start = splits[:-1][text] + k * STRIDE
    return text, start, np.clip(splits[1:][text] - start, 0, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in p; vocabulary: sorted hashes, row i + 1 of p["word"] (row 0: unknown)."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        make = lambda *s, f: (r.standard_normal(s) * f).astype(np.float32)
        self.vocabulary = vocabulary
        self.chance = np.random.default_rng(seed + 1)
        self.p = {
            "word": make(len(vocabulary) + 1, WORD_DIM, f=0.1), "char": make(CHAR_ROWS, CHAR_DIM, f=0.2),
            "w": make(d, 6 * h, f=d**-0.5), "b": np.zeros(6 * h, np.float32), "u": make(2, h, 3 * h, f=h**-0.5),
            "a": make(2 * h, QUERY_DIM, f=(2 * h) ** -0.5), "v": make(QUERY_DIM, f=QUERY_DIM**-0.5),
            "o": make(2 * h, f=(2 * h) ** -0.5), "c": np.full(1, -1.0, np.float32),
        }
        self.p["word"][0] = 0

    def rows(self, kinds: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(kinds), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, kinds), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == kinds, at + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        """What each distinct word adds to the gates; a last row of zeros stands for no word."""
        x = np.concatenate([self.p["word"][self.rows(words.kinds)], _means(self.p["char"], words.grams, words.ends)], axis=1)
        g = x @ self.p["w"] + self.p["b"]
        return np.concatenate([g, np.zeros((1, g.shape[1]), np.float32)])

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates: [L, B, 6h]; mask: [L, B]. Logits of each window, and what backward needs."""
        n, b, h = len(gates), mask.shape[1], HIDDEN
        p = self.p
        both = np.stack([gates[:, :, : 3 * h], gates[::-1, :, 3 * h :]], axis=1)  # [L, 2, B, 3h]
        on = np.stack([mask, mask[::-1]], axis=1)[..., None]  # [L, 2, B, 1]
        state, states, saved = np.zeros((2, b, h), np.float32), np.empty((n, 2, b, h), np.float32), []
        for t in range(n):
            back = np.matmul(state, p["u"])
            rz = _sigmoid(both[t, :, :, : 2 * h] + back[:, :, : 2 * h])
            r, z = rz[:, :, :h], rz[:, :, h:]
            new = np.tanh(both[t, :, :, 2 * h :] + r * back[:, :, 2 * h :])
            if keep:
                saved.append((state, r, z, new, back[:, :, 2 * h :]))
            state = state + on[t] * (1 - z) * (new - state)
            states[t] = state
        seen = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # [L, B, 2h]
        u = np.tanh(seen @ p["a"])
        s = np.where(mask > 0, u @ p["v"], np.float32(-30))
        e = np.exp(s - s.max(axis=0)) * mask
        alpha = e / np.maximum(e.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("lb,lbh->bh", alpha, seen)
        logits = pooled @ p["o"] + p["c"][0]
        return (logits, (seen, u, alpha, pooled, on, saved)) if keep else logits

    def backward(self, cache, error: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of the gates [L, B, 6h]."""
        seen, u, alpha, pooled, on, saved = cache
        p, h, n = self.p, HIDDEN, len(seen)
        g = {"o": pooled.T @ error, "c": error.sum(keepdims=True)}
        dpooled = error[:, None] * p["o"]
        dseen = alpha[..., None] * dpooled
        dalpha = np.einsum("lbh,bh->lb", seen, dpooled)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("lb,lbq->q", ds, u)
        du = ds[..., None] * p["v"] * (1 - u * u)
        g["a"] = np.einsum("lbh,lbq->hq", seen, du)
        dseen += du @ p["a"].T
        dstates = np.stack([dseen[:, :, :h], dseen[::-1, :, h:]], axis=1)
        g["u"] = np.zeros_like(p["u"])
        dboth = np.zeros((n, 2, seen.shape[1], 3 * h), np.float32)
        carry = np.zeros_like(dstates[0])
        for t in range(n - 1, -1, -1):
            state, r, z, new, inner = saved[t]
            d = carry + dstates[t]
            dn = d * on[t] * (1 - z) * (1 - new * new)
            dz = d * on[t] * (state - new) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dboth[t] = np.concatenate([dr, dz, dn], axis=2)
            dback = np.concatenate([dr, dz, dn * r], axis=2)
            g["u"] += np.matmul(state.transpose(0, 2, 1), dback)
            carry = d * (1 - on[t] * (1 - z)) + np.matmul(dback, p["u"].transpose(0, 2, 1))
        return g, np.concatenate([dboth[:, 0], dboth[::-1, 1]], axis=2)

    def score(self, words: Words) -> np.ndarray:
        """The highest window's probability, of each text."""
        text, start, length = windows_of(words.splits)
        table_, which = self.inputs(words), np.append(words.which, len(words.kinds))
        best = np.full(len(words.splits) - 1, -np.inf)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), SCORE_BATCH):
            own = order[i : i + SCORE_BATCH]
            gates, mask = _gather(table_, which, start[own], length[own])
            np.maximum.at(best, text[own], self.forward(gates, mask).astype(np.float64))
        return 0.5 * np.tanh(0.5 * best) + 0.5


def _gather(table_: np.ndarray, which: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Gate inputs [L, B, 6h] and mask [L, B] of windows. which ends with the empty word."""
    n = max(1, int(length.max(initial=0)))
    at = start[None, :] + np.arange(n)[:, None]
    on = np.arange(n)[:, None] < length[None, :]
    return table_[which[np.where(on, at, len(which) - 1)]], on.astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray) -> Network | None:
    """From whole texts and the label of each."""
    if not len(labels) or labels.min() == labels.max():
        return None
    words = words_of(texts)
    owner, start, length = windows_of(words.splits)
    which = np.append(words.which, len(words.kinds))
    at = np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)
    pairs = np.unique(np.repeat(np.arange(len(owner)), length) * np.int64(len(words.kinds) + 1) + which[at])
    spread = np.bincount(pairs % (len(words.kinds) + 1), minlength=len(words.kinds))
    net = Network(words.kinds[spread >= LEAST_WINDOWS])
    rows = net.rows(words.kinds)
    target = labels[owner].astype(np.float32)
    r, moments, step = np.random.default_rng(11), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}, 0
    batch = min(BATCH, max(16, len(labels) // 8))
    epochs = max(EPOCHS, -(-STEPS * batch // (2 * len(labels))))
    for epoch in range(epochs):
        if epoch < epochs // 4:
            chosen = np.flatnonzero(r.random(len(owner)) < min(1.0, 2 * len(labels) / len(owner)))
        else:  # the highest window stands for its document, and another of each clean one
            gates = net.inputs(words)
            logits, by_length = np.empty(len(owner), np.float32), np.argsort(length, kind="stable")
            for i in range(0, len(owner), SCORE_BATCH):
                own = by_length[i : i + SCORE_BATCH]
                logits[own] = net.forward(*_gather(gates, which, start[own], length[own]))
            order = np.lexsort((-logits, owner))
            top = order[np.unique(owner[order], return_index=True)[1]]
            other = np.flatnonzero((target == 0) & (r.random(len(owner)) < 0.15))
            chosen = np.unique(np.concatenate([top, other]))
        r.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            own = chosen[i : i + batch]
            gates, mask, used = _training_gates(net, words, rows, which, start[own], length[own])
            logits, cache = net.forward(gates, mask, keep=True)
            error = (_sigmoid(logits) - target[own]) / len(own)
            g, dgates = net.backward(cache, error)
            g |= _input_gradients(net, used, dgates)
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                v = v + DECAY * net.p[k] if k in ("word", "char") else v
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= RATE * SLOWER ** (epoch * EPOCHS / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            net.p["word"][0] = 0
    return net


def _training_gates(net, words, rows, which, start, length):
    n = max(1, int(length.max(initial=0)))
    at = start[None, :] + np.arange(n)[:, None]
    on = np.arange(n)[:, None] < length[None, :]
    ids = which[np.where(on, at, len(which) - 1)]
    kinds, inverse = np.unique(ids, return_inverse=True)
    real = kinds[kinds < len(words.kinds)]
    known = rows[real] * (net.chance.random(len(real)) >= DROPPED)
    length = np.diff(words.ends)[real]
    bounds = np.zeros(len(real) + 1, np.int64)
    np.cumsum(length, out=bounds[1:])
    grams = words.grams[np.arange(bounds[-1]) - np.repeat(bounds[:-1], length) + np.repeat(words.ends[:-1][real], length)]
    x = np.concatenate([net.p["word"][known], _means(net.p["char"], grams, bounds)], axis=1)
    g = x @ net.p["w"] + net.p["b"]
    if len(real) < len(kinds):
        g = np.concatenate([g, np.zeros((1, g.shape[1]), np.float32)])
    return g[inverse.reshape(ids.shape)], on.astype(np.float32), (real, known, grams, length, inverse.reshape(-1), x)


def _input_gradients(net, used, dgates) -> dict:
    real, known, grams, length, inverse, x = used
    flat = dgates.reshape(len(inverse), -1)
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], np.arange(len(real)))
    total = np.add.reduceat(np.concatenate([flat[order], np.zeros((1, flat.shape[1]), np.float32)]), starts, axis=0) if len(real) else np.zeros((0, flat.shape[1]), np.float32)
    if len(real) and inverse.max() >= len(real):  # the last sum also holds the empty word's rows
        total[-1] -= flat[inverse == len(real)].sum(axis=0)
    dx = total @ net.p["w"].T
    word = np.zeros_like(net.p["word"])
    np.add.at(word, known, dx[:, :WORD_DIM])
    char = np.zeros_like(net.p["char"])
    np.add.at(char, grams, np.repeat(dx[:, WORD_DIM:] / np.maximum(length, 1)[:, None], length, axis=0).astype(np.float32))
    return {"w": x.T @ total, "b": total.sum(axis=0), "word": word, "char": char}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Network | None:
    """The network from at most rows labelled documents of each kind, chosen by a hash of the id.
    It is trained in one task, which holds 2 * rows texts at most; the driver gets the parameters."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    by_hash = [F.xxhash64("__id"), F.col("__id")]
    sample = known.filter("__label = 1").orderBy(*by_hash).limit(rows).unionAll(known.filter("__label = 0").orderBy(*by_hash).limit(rows))
    # At most 2 * rows ids and labels: a side of bounded size.
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    texts = texts.groupBy("__id", "__label").agg(F.max_by("__text", F.xxhash64("__text")).alias("__text")).withColumn("__all", F.lit(0))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("__id").combine_chunks()
        net = train(table.column("__text").combine_chunks(), table.column("__label").to_numpy())
        return pa.table({"__model": pa.array([pickle.dumps(net)], pa.binary())})

    got = texts.groupBy("__all").applyInArrow(learn, "__model binary").collect()  # one row at most
    return pickle.loads(bytes(got[0][0])) if got else None


def score_documents(docs: DataFrame, net: Network | None, text_col: str = "text", name: str = "__score") -> DataFrame:
    """docs with the score of each whole text."""
    docs = docs.drop(name)
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample's vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for piece in slices(batch, text_col):
                scores = np.zeros(piece.num_rows) if own is None else own.score(words_of(piece.column(text_col)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores, pa.float64())], names=[*piece.schema.names, name])

    return docs.mapInArrow(score, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    net = fit(docs, labels.filter(~in_bucket("doc_id", 4, 2)))
    scored = score_documents(docs, net)
    return scored.select("doc_id", in_bucket("doc_id", 4, 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
