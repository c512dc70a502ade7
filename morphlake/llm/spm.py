"""SentencePiece encoding and decoding in numpy, for unigram and byte-pair models.

A text is cut where no piece can lie: between two characters that stand side by side in no
piece. The parts are few distinct short words; each distinct word is encoded once. Words of
equal length advance together: hashes of their substrings, taken from running sums, probe the
sorted hashes of the pieces.

Unigram models are decoded by Viterbi: at each end, the best of all pieces that end there is
kept with its length as a backpointer, for all words of a length at once. Byte-pair models are
defined by another rule (merge the pair of the best piece, again and again), which no sum of
scores reproduces; for them the same batches merge one pair a step. Characters without a piece
become the pieces of their bytes.

Only models with the identity normalizer are read. Defined cases: null and empty texts have no
ids and decode to the empty text; U+2581 in a text is a blank, as in the library, so it comes
back as one. Nothing is cut: any text of any length is encoded. Rows that repeat are each encoded. Extra columns
pass through; one with the name of a result gives way to it.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm.common import _BASE, _INVERSE, U, _power_table, bounded_batches, mix, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
UNIGRAM, BPE = 1, 2
#: Words longer than this are merged one by one with a heap, in time n log n.
LONG = 200
#: What an unknown character costs below the worst piece, in unigram models.
UNKNOWN_PENALTY = 10.0
assert _BASE * _INVERSE % (1 << 64) == 1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            value, at = data[at : at + 4], at + 4
        yield key >> 3, value


@dataclass
class Model:
    kind: int
    dummy_prefix: bool
    pieces: list[bytes]  # what each id decodes to
    keys: np.ndarray  # sorted hashes of the pieces' characters
    ids: np.ndarray  # id of each key
    scores: np.ndarray  # score of each key
    single: np.ndarray  # by character: whether it is a piece
    beside: np.ndarray  # sorted pairs of characters that stand side by side in a piece
    longest: int
    bytes_at: np.ndarray  # id of each byte's piece, or of <unk>


def _hash_spans(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _hash_between(*_sums(chars), starts, ends)


def _sums(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_table(len(chars) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(chars) + 1, U)
        np.cumsum(mix(chars.astype(U) + U(0x9E3779B9)) * up[: len(chars)], out=total[1:])
    return total, down


def _hash_between(total, down, starts, ends):
    with np.errstate(over="ignore"):
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def make_model(pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True) -> Model:
    """pieces: text, score and type (1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte) by id."""
    normal = [i for i, (_, _, t) in enumerate(pieces) if t in (1, 4)]
    chars = np.array([ord(c) for i in normal for c in pieces[i][0]], np.uint32)
    ends = np.cumsum([len(pieces[i][0]) for i in normal]).astype(np.int64) if normal else np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1]).astype(np.int64) if normal else ends
    hashes = _hash_spans(chars, starts, ends)
    order = np.argsort(hashes)
    single = np.zeros(0x110000, bool)
    beside = set()
    for i in normal:
        text = pieces[i][0]
        if len(text) == 1:
            single[ord(text)] = True
        beside.update(ord(a) << 32 | ord(b) for a, b in zip(text, text[1:]))
    unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == 2), 0)
    byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
    out = [b"" if t == 3 else bytes([int(p[3:5], 16)]) if t == 6 else " ⁇ ".encode() if t == 2 else p.replace("▁", " ").encode() for p, _, t in pieces]
    return Model(kind, dummy_prefix, out, hashes[order], np.array(normal, np.int64)[order], np.array([pieces[i][1] for i in normal])[order], single, np.array(sorted(beside), np.int64), max((len(pieces[i][0]) for i in normal), default=1), np.array([byte.get(b, unknown) for b in range(256)], np.int64))


def read_model(path: str = MODEL) -> Model:
    """The model of a .model file, read on the driver."""
    pieces, kind, dummy, normalizer = [], UNIGRAM, True, "identity"
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, 1)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            x = dict(_fields(value))
            normalizer, dummy = x.get(1, b"identity").decode(), bool(x.get(3, 1))
            if normalizer != "identity" or x.get(4, 1) or not x.get(5, 1):
                raise ValueError(f"{path}: only the identity normalizer that keeps white space is supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"{path}: neither a unigram nor a byte-pair model")
    return make_model(pieces, kind, dummy)


def _probe(m: Model, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash among the keys, or -1."""
    if not len(m.keys):
        return np.full(hashes.shape, -1, np.int64)
    at = np.minimum(np.searchsorted(m.keys, hashes), len(m.keys) - 1)
    return np.where(m.keys[at] == hashes, at, -1)


def _viterbi(m: Model, total, down, base: np.ndarray, length: int) -> np.ndarray:
    """Ends of the best segmentation of words of one length, as marks [words, length]."""
    n = len(base)
    floor = (m.scores.min() if len(m.scores) else 0.0) - UNKNOWN_PENALTY
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.ones((n, length + 1), np.int16)
    for end in range(1, length + 1):
        widths = np.arange(1, min(m.longest, end) + 1)
        starts = base[:, None] + end - widths
        rows = _probe(m, _hash_between(total, down, starts, np.broadcast_to((base + end)[:, None], starts.shape)))
        gain = np.where(rows >= 0, m.scores[rows], -np.inf)
        gain[:, 0] = np.where(rows[:, 0] >= 0, gain[:, 0], floor)
        reach = best[:, end - widths] + gain
        pick = reach.argmax(axis=1)
        best[:, end] = reach[np.arange(n), pick]
        back[:, end] = widths[pick]
    marks, at = np.zeros((n, length), bool), np.full(n, length)
    while (live := at > 0).any():
        marks[live, at[live] - 1] = True
        at = np.where(live, at - back[np.arange(n), at], 0)
    return marks


def _merge(m: Model, total, down, base: np.ndarray, length: int) -> np.ndarray:
    """Ends of the symbols after all merges of words of one length, as marks [words, length]."""
    marks = np.zeros((len(base), length), bool)
    rows = np.arange(len(base))
    ends = np.tile(np.arange(length + 1, dtype=np.int32), (len(base), 1))  # ends[:, 0] is the word's start

    def score(own, a, b):
        found = _probe(m, _hash_between(total, down, base[own] + a, base[own] + b))
        return np.where(found >= 0, m.scores[found], -np.inf)

    if length > 1:
        gain = score(np.repeat(rows, length - 1), ends[:, :-2].ravel(), ends[:, 2:].ravel()).reshape(len(base), length - 1)
    else:
        gain = np.zeros((len(base), 0))
    while True:
        count = ends.shape[1] - 1
        pick = gain.argmax(axis=1) if count > 1 else np.zeros(len(rows), np.int64)
        done = gain[np.arange(len(rows)), pick] == -np.inf if count > 1 else np.ones(len(rows), bool)
        if done.any():
            own = np.flatnonzero(done)
            marks[np.repeat(rows[own], count), ends[own, 1:].ravel() - 1] = True
            keep = ~done
            rows, ends, gain, pick = rows[keep], ends[keep], gain[keep], pick[keep]
        if not len(rows):
            return marks
        i = np.arange(len(rows))
        kept = np.arange(count)[None, :] + (np.arange(count)[None, :] >= pick[:, None] + 1)  # drop the end inside the new symbol
        ends = np.take_along_axis(ends, kept, axis=1)
        if count <= 2:
            gain = np.zeros((len(rows), 0))
            continue
        cols = np.arange(count - 2)
        gain = np.take_along_axis(gain, cols[None, :] + (cols[None, :] >= pick[:, None]), axis=1)
        left, right = pick > 0, pick < count - 2
        gain[i[left], pick[left] - 1] = score(rows[left], ends[left, pick[left] - 1], ends[left, pick[left] + 1])
        gain[i[right], pick[right]] = score(rows[right], ends[right, pick[right]], ends[right, pick[right] + 2])


def _merge_long(m: Model, total, down, base: int, length: int) -> np.ndarray:
    """The same for one long word, with a heap of pairs."""
    after, before = list(range(1, length + 1)), list(range(-1, length - 1))
    alive = [True] * length
    end = list(range(1, length + 1))

    def score(a: int, b: int) -> float:
        row = _probe(m, _hash_between(total, down, np.array([base + a]), np.array([base + b])))[0]
        return m.scores[row] if row >= 0 else -np.inf

    first = np.arange(length - 1)
    rows = _probe(m, _hash_between(total, down, base + first, base + first + 2))
    heap = [(-m.scores[r], i, i + 1, i + 2) for i, r in zip(first[rows >= 0].tolist(), rows[rows >= 0].tolist(), strict=True)]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or middle >= length or not alive[middle] or end[middle] != stop:
            continue
        alive[middle], end[i], after[i] = False, stop, after[middle]
        if after[i] < length:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if 0 <= a and b < length:
                s = score(a, end[b])
                if s > -np.inf:
                    heapq.heappush(heap, (-s, a, b, end[b]))
    marks = np.zeros(length, bool)
    marks[np.array([end[i] for i in range(length) if alive[i]]) - 1] = True
    return marks


def encode(m: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the range of each text's ids."""
    lead = "▁" if m.dummy_prefix else ""
    whole = [lead + x if x else "" for x in texts]
    chars = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32).copy()
    chars[chars == 32] = BLANK
    bounds = np.zeros(len(whole) + 1, np.int64)
    np.cumsum([len(x) for x in whole], out=bounds[1:])
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(len(whole) + 1, np.int64)
    begins = np.ones(len(chars), bool)
    pair = chars[:-1].astype(np.int64) << 32 | chars[1:]
    kinds, which = np.unique(pair, return_inverse=True)
    begins[1:] = ~np.isin(kinds, m.beside)[which]
    begins[bounds[:-1][bounds[:-1] < len(chars)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(chars))
    total, down = _sums(chars)
    _, first, which = np.unique(_hash_between(total, down, starts, ends), return_index=True, return_inverse=True)
    # the distinct words, by length
    base, length = starts[first], (ends - starts)[first]
    order = np.argsort(length, kind="stable")
    steps = np.append(np.flatnonzero(np.diff(length[order], prepend=-1)), len(order))
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        own, n = order[a:b], int(length[order[a]])
        if m.kind == BPE and n > LONG:
            marks = np.stack([_merge_long(m, total, down, int(x), n) for x in base[own]])
        elif n == 1:
            marks = np.ones((len(own), 1), bool)
        else:
            room = max(1, (1 << 21) // (n * (m.longest if m.kind == UNIGRAM else 1)))
            parts = [base[own[i : i + room]] for i in range(0, len(own), room)]
            marks = np.concatenate([(_merge if m.kind == BPE else _viterbi)(m, total, down, x, n) for x in parts])
        row, col = np.nonzero(marks)
        stop = base[own][row] + col + 1
        start = np.where(np.diff(row, prepend=-1) != 0, base[own][row], np.append(0, stop[:-1]))
        spans.append((own[row], start, stop))
    word, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
    found = _probe(m, _hash_between(total, down, start, stop))
    known = found >= 0
    # characters without a piece: the pieces of their bytes
    odd = chars[start[~known]]
    spelled = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in odd.tolist()]
    size = np.ones(len(word), np.int64)
    size[~known] = [len(x) for x in spelled]
    ids = np.empty(size.sum(), np.int64)
    place = np.cumsum(size) - size
    ids[place[known]] = m.ids[found[known]]
    if len(spelled):
        at = np.repeat(place[~known], size[~known]) + np.arange(size[~known].sum()) - np.repeat(np.cumsum(size[~known]) - size[~known], size[~known])
        ids[at] = m.bytes_at[np.concatenate(spelled)]
    # words lie in ids by length; each word's range
    owner = np.repeat(word, size)
    sizes = np.bincount(owner, minlength=len(first))
    by_word = np.argsort(owner, kind="stable")
    ids, head = ids[by_word], np.cumsum(sizes) - sizes
    made = sizes[which]
    out = np.repeat(head[which], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    ends_of_words = np.append(0, np.cumsum(made))
    splits = ends_of_words[np.searchsorted(starts, bounds)]
    return ids[out], splits


def decode(m: Model, ids: np.ndarray, splits: np.ndarray) -> list[str]:
    pieces, out = m.pieces, []
    for a, b in zip(splits[:-1].tolist(), splits[1:].tolist(), strict=True):
        text = b"".join(map(pieces.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace")
        out.append(text[1:] if m.dummy_prefix and text.startswith(" ") else text)
    return out


def encode_documents(docs: DataFrame, text_col: str = "text", path: str = MODEL, ids: str = "__ids", back: str | None = None) -> DataFrame:
    """docs with the ids of each text and, if back is named, what they decode to."""
    docs = docs.drop(ids, *([back] if back else []))
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))
    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(back, T.StringType())] if back else [])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                flat, splits = encode(model.value, piece.column(text_col).to_pylist())
                new = [pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), pa.array(flat.astype(np.int32)))]
                if back:
                    new.append(pa.array(decode(model.value, flat, splits), pa.string()))
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, *(f.name for f in more)])

    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, *more]))


def decode_documents(docs: DataFrame, ids: str = "__ids", path: str = MODEL, name: str = "__text") -> DataFrame:
    """docs with the text of each list of ids. A null list is empty."""
    docs = docs.drop(name)
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(ids).to_pylist()]
            splits = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
            texts = decode(model.value, np.concatenate([np.zeros(0, np.int64), *lists]), splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, back="__back")
    same = F.col("__back").eqNullSafe(F.translate(F.coalesce("text", F.lit("")), "▁", " "))
    return out.select("doc_id", F.col("__ids").alias("ids"), F.size("__ids").cast("long").alias("n_tokens"), same.alias("round_trip"))
