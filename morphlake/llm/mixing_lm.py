"""Language-model scores by online logistic context mixing.

A text is its words (runs of bytes other than ASCII white space, A-Z folded) and one end. A
word of the vocabulary is coded by a prefix code made from its training count, any other word
by an escape and its bytes. Each binary decision is predicted in several contexts; a context
and the decision's place in the code are hashed to a slot of a table of fixed size, whose
counts of zeros and ones come from all training documents. The slots' log-odds are combined by
weights chosen (gated) by how much each slot has seen, and by weights of the document that
follow its coding errors block by block, and an adaptive probability map refines the result.
The decisions' probabilities multiply to the text's probability, and its bits per byte follow.

Beside it: a smoothed unigram score with exact counts of every training token. That knows V + 1
events, the words seen in training and one for any other. To be held against it, the text is also
scored over these events: what stands behind an escape is then charged not by its spelling but by its
count among the words without codes, smoothed as in the base.

Defined cases: null and empty texts are one end token. Null ids count as the empty text in the
held-out rule. Rows that repeat an id are each scored. Without training documents, N and V are
0 and the model is untrained. Extra columns are ignored.

Sizes that don't follow the input: the vocabulary and the tables. The mixing weights are tuned on
all training documents, each taken whole. They are dealt to folds, and each is tuned on with tables
that lack its own fold, so that the weights are tuned on unseen text. They are dealt to PASSES parts,
one for each pass, however many they are; rows that repeat an id or a text are dealt row by row. Word and byte counts, N, V and the counts of the tables that score are gathered from
all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm import common
from morphlake.llm.common import U, alone, bounded_batches, in_bucket, mix, slices, stored_alone, table

#: Words with codes of their own, at most; each needs this many training occurrences.
VOCABULARY, LEAST = 1 << 18, 2
#: Words of the vocabulary with fewer occurrences also teach spelling.
SPELLED = 8
#: Slots of each context's table, as powers of two: code alone, last frequent word, last word.
SLOTS = (20, 20, 20)
#: The words whose last occurrence is a context, by rank.
FREQUENT = 64
#: Training documents of a shard, on which weights are tuned in order; passes, after each of which the units' are averaged.
TUNING, PASSES = 400, 3
#: Rows of averages that reach the driver after a pass, at most.
AVERAGES = 64
#: Folds of these documents.
FOLDS = 5
#: Tokens of a document between two updates of its own weights, and the rates. The latter fits steps of TUNED_ROWS texts or more.
BLOCK, DOC_RATE, TUNE_RATE = 48, 0.02, 0.006
#: Bytes of text that are scored, counted and tuned on at once; one longer text is taken whole.
#: Only the last matters to the result: its texts' blocks share a step of the weights.
CHUNK, GATHER, TUNED = 256 << 10, 1 << 20, 64 << 10
#: Texts that are scored and tuned on at once, at least, unless they hold over common.CHUNK_BYTES: the steps of few texts are small.
SCORED_ROWS, TUNED_ROWS = 64, 32
#: Decisions of several blocks whose inputs are looked up at once.
TOGETHER = 1 << 15
#: Words whose counts a task merges before it sends them (8 bytes each).
COUNTED = 1 << 20
#: Bytes of memory, twice over, that a task keeps for its next arrays.
KEPT = 30 << 20
HEAD = 20  # leading bits of a word's hash by which it is looked up
GATES = 4  # levels of what a slot has seen
APM = 33
#: Slots in one row of the shuffle of tables.
PIECE = 1 << 14
END = U(0x5851F42D4C957F2D)

S = np.uint32
_SEEDS = [S(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
#: Log-odds are kept in steps of this size beside the gate, in 16 bits.
STEP = np.float32(1 / 512)
LOG2_E = 1 / np.log(2)


@dataclass
class Codes:
    """words: sorted hashes; code and bits of each; the escape's code comes last, the end's is that of END."""

    words: np.ndarray
    counts: np.ndarray
    code: np.ndarray
    bits: np.ndarray
    frequent: np.ndarray  # rank + 1 of words among the most frequent, else 0; escape 0
    n: int
    v: int
    weights: np.ndarray | None = None
    apm: np.ndarray | None = None
    byte_code: np.ndarray | None = None
    byte_bits: np.ndarray | None = None
    tables: list = field(default_factory=list)  # by slot: steps of log-odds * 4 + gate
    starts: np.ndarray | None = None  # where the words of each leading HEAD bits begin

    def index_of(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or its length. Words of equal leading bits are few, so
        they are tried one after another."""
        none = len(self.words)
        if self.starts is None:
            self.starts = np.searchsorted(self.words >> U(64 - HEAD), np.arange((1 << HEAD) + 1, dtype=U))
        head = (hashes >> U(64 - HEAD)).astype(np.intp)
        at, end = self.starts[head], self.starts[head + 1]
        out, left = np.full(len(hashes), none), np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.words[here] == hashes[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def code_lengths(share: np.ndarray) -> np.ndarray:
    """Bits of each symbol in a shortest prefix code: the two least shares are joined, again and again.
    Leaves in order and joined nodes, which come in order, are two queues."""
    n = len(share)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(share, kind="stable")
    leaves, nodes, above = share[order].tolist(), [], [0] * (2 * n - 1)
    i = j = 0
    for k in range(n, 2 * n - 1):
        total = 0.0
        for _ in range(2):
            if i < n and (j == len(nodes) or leaves[i] <= nodes[j]):
                total += leaves[i]
                above[i] = k
                i += 1
            else:
                total += nodes[j]
                above[n + j] = k
                j += 1
        nodes.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[above[k]] + 1
    bits = np.empty(n, np.int64)
    bits[order] = depth[:n]
    return bits


def prefix_code(weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their bits (30 at most) by share of weight; no share counts as under least."""
    share = np.maximum(weight / weight.sum(), least)
    bits = code_lengths(share)
    if bits.max() > 30:  # shares that fall off so steeply get a code that is longer by less than a bit each
        bits = np.maximum(np.ceil(-np.log2(share / share.sum())), 1).astype(np.int64)
    first = np.lexsort((np.arange(len(bits)), bits))
    step = np.int64(1) << (30 - bits[first])
    code = np.empty(len(bits), np.int32)
    code[first] = (np.cumsum(step) - step) >> (30 - bits[first])
    return code, bits


def make_codes(words: np.ndarray, counts: np.ndarray, n: int, v: int, letters: np.ndarray | None = None) -> Codes:
    """letters: how often each byte stands in the training texts (a blank: all white space)."""
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    weight = np.append(counts, max(1, n - int(counts.sum()))).astype(np.float64)
    code, bits = prefix_code(weight, 2.0**-28)
    rank = np.zeros(len(bits), np.int64)
    top = np.argsort(-counts, kind="stable")[:FREQUENT]
    rank[top] = np.arange(1, len(top) + 1)
    letters = np.full(256, 1.0) if letters is None else letters + 1e-3
    byte_code, byte_bits = prefix_code(letters, 2.0**-14)
    return Codes(words, counts, code, bits, rank, n, v, byte_code=byte_code, byte_bits=byte_bits)


@dataclass
class Symbols:
    """What is coded, one after another: words, ends, escapes, and bytes of spelled words."""

    code: np.ndarray
    bits: np.ndarray
    contexts: list  # a hash of each context, by symbol
    doc: np.ndarray
    block: np.ndarray
    letter: np.ndarray  # whether it is a byte of a spelled word


@dataclass
class Tokens:
    hashes: np.ndarray  # with an END after each text
    splits: np.ndarray
    index: np.ndarray  # into the vocabulary; its length for others
    known: np.ndarray


def keep_memory() -> None:
    """Tells the C library to keep what this process frees, up to twice this size: it follows the largest array that was
    freed. Else each block's arrays are given back and touched anew."""
    whole = np.empty(KEPT, np.uint8)
    del whole


def tokens_of(texts: pa.Array, codes: Codes, also: np.ndarray | None = None) -> tuple[Tokens, Symbols]:
    """also: words of the vocabulary to spell as well, to learn spelling from them."""
    raw, offsets = common.buffer_of(texts)
    raw = common.lowered(raw)
    starts, ends, splits = common.word_spans(raw, offsets)
    words = common.span_hashes(raw, starts, ends)
    counts = np.diff(splits)
    n = len(counts)
    out = np.zeros(n + 1, np.int64)
    np.cumsum(counts + 1, out=out[1:])
    place = np.arange(len(words)) + np.repeat(np.arange(n), counts)
    hashes = np.full(out[-1], END, U)
    hashes[place] = words
    length = np.zeros(out[-1], np.int64)
    length[place] = ends - starts
    at = np.zeros(out[-1], np.int64)
    at[place] = starts
    index = codes.index_of(hashes)
    tokens = Tokens(hashes, out, index, index < len(codes.words))

    doc = np.repeat(np.arange(n), counts + 1)
    first = out[:-1]
    # contexts of words
    previous = np.empty(len(hashes), U)
    previous[1:] = hashes[:-1]
    previous[first] = 0
    rank = codes.frequent[index]
    seen = np.where(rank > 0, np.arange(len(rank)), -1)
    last = np.empty(len(rank), np.int64)
    last[1:] = np.maximum.accumulate(seen)[:-1]
    last[first] = -1
    last = np.where(last >= np.repeat(first, counts + 1), last, -1)
    regime = np.where(last >= 0, rank[np.maximum(last, 0)], 0).astype(U)
    # spelled words follow their escapes: their bytes and a blank
    spelled = np.flatnonzero(~tokens.known if also is None else ~tokens.known | also[index])
    extra = np.zeros(len(hashes), np.int64)
    extra[spelled] = length[spelled] + 1
    size = 1 + extra
    begin = np.cumsum(size) - size
    total = int(size.sum())
    inner = np.ones(total, bool)
    inner[begin] = False
    own = np.repeat(spelled, extra[spelled])
    k = np.arange(len(own)) - np.repeat(np.cumsum(extra[spelled]) - extra[spelled], extra[spelled])
    byte = np.where(k < length[own], raw[np.minimum(at[own] + k, len(raw) - 1)], np.uint8(32)) if len(raw) else np.full(len(own), 32, np.uint8)
    back = [np.zeros(len(byte), U) for _ in range(5)]
    for i, x in enumerate(back, 1):
        x[i:] = np.where(k[i:] >= i, byte[:-i], np.uint8(0))
    with np.errstate(over="ignore"):
        spell, near = U(1) << U(60), back[1] << U(8) | back[0]
        of_bytes = [
            spell + near,
            spell + (back[2] << U(16) | near | U(1) << U(50)),
            spell + (back[4] << U(32) | back[3] << U(24) | back[2] << U(16) | near | U(1) << U(51)),
        ]
        of_words = [None, regime + U(1 << 50), previous | U(1)]
        contexts = []
        for words_, bytes_ in zip(of_words, of_bytes, strict=True):
            x = np.empty(total, S)
            x[begin] = 0 if words_ is None else mix(words_) >> U(32)
            x[inner] = mix(bytes_) >> U(32)
            contexts.append(x)
    code, bits, token = np.empty(total, codes.code.dtype), np.empty(total, np.int64), np.repeat(np.arange(len(hashes)), size)
    code[begin], code[inner] = codes.code[index], codes.byte_code[byte]
    bits[begin], bits[inner] = codes.bits[index], codes.byte_bits[byte]
    block = (np.arange(len(hashes)) - np.repeat(first, counts + 1)) // BLOCK
    return tokens, Symbols(code, bits, contexts, doc[token], block[token], inner)


def _decisions(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Place in its symbol's code (as a prefix with a leading one) and value of each decision."""
    ends = np.cumsum(s.bits)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(ends.astype(np.int32), s.bits)  # bits still to come
    shift -= np.arange(total, dtype=np.int32)
    code = np.repeat(s.code | np.int32(1) << s.bits.astype(np.int32), s.bits)
    node = code >> shift
    shift -= np.int32(1)
    code >>= shift
    code &= np.int32(1)
    return node, code.astype(np.int8)


def _slots(context: np.ndarray, bits: np.ndarray, node: np.ndarray, c: int) -> np.ndarray:
    with np.errstate(over="ignore"):  # contexts are hashes, so one more product spreads the places in codes
        x = node.astype(S)
        x *= _SEEDS[c]
        x ^= np.repeat(context, bits)
        x *= S(0x27D4EB2F)
        x >>= S(32 - SLOTS[c])
        return x.astype(np.intp)  # gathers want indexes of this type


def count_into(counts: list, texts: pa.Array, codes: Codes) -> None:
    """Adds the texts' decisions to the tables of zeros and ones. A symbol that stands several
    times in a context is taken apart once."""
    _, s = tokens_of(texts, codes, np.append(codes.counts < SPELLED, False))
    marked = (s.code.astype(np.int64) | np.int64(1) << s.bits).astype(U)  # a leading one tells its length
    for c, context in enumerate(s.contexts):
        pairs, times = np.unique(context.astype(U) << U(32) | marked, return_counts=True)
        whole = (pairs & U(0xFFFFFFFF)).astype(np.int64)
        bits = np.frexp(whole)[1].astype(np.int64) - 1
        node, bit = _decisions(Symbols((whole ^ np.int64(1) << bits).astype(np.int32), bits, [], None, None, None))
        # index and number in the table's own types: else add.at is many times slower
        at = _slots((pairs >> U(32)).astype(S), bits, node, c)
        at += at
        at += bit
        np.add.at(counts[c], at, np.repeat(times.astype(counts[c].dtype), bits))


def packed(piece: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Where a piece of counts isn't zero (a bit for each place, or the places of few), the counts there as bytes,
    and what counts of 255 and more have beyond it."""
    at = np.flatnonzero(piece)
    where = at.astype(np.uint16) if 16 * len(at) < len(piece) else np.packbits(piece != 0)
    counts = piece[at]
    return where.tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), (counts[counts >= 255] - 255).astype(np.int32).tobytes()


def unpacked_into(total: np.ndarray, where: bytes, counts: bytes, more: bytes) -> None:
    """Adds a piece of counts that packed() made."""
    at = np.frombuffer(where, np.uint16) if 8 * len(where) < len(total) else np.flatnonzero(np.unpackbits(np.frombuffer(where, np.uint8)))
    counts = np.frombuffer(counts, np.uint8).astype(total.dtype)
    counts[counts == 255] += np.frombuffer(more, np.int32)
    total[at] += counts


def tables_of(counts: list) -> list:
    out = []
    for pair in counts:
        zeros, ones = pair[0::2].astype(np.float32), pair[1::2].astype(np.float32)
        n = zeros + ones
        odds = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
        gate = np.searchsorted([1, 4, 30], n, side="right").astype(np.int8)
        steps = np.clip(np.round(odds / STEP), -8191, 8191).astype(np.int16)
        out.append(steps * np.int16(4) + gate)
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.exp(out, out=out)  # exp and log of 32 bits are vectorised, tanh and log2 are not
    out += np.float32(1)
    return np.reciprocal(out, out=out)


def _inputs(codes: Codes, s: Symbols, node: np.ndarray) -> tuple[list, np.ndarray]:
    """Log-odds of each context and a constant; the gate of each decision."""
    x, gate = [], np.zeros(len(node), np.int16)
    for c, slots in enumerate(codes.tables):
        found = slots.take(_slots(s.contexts[c], s.bits, node, c), mode="wrap")
        x.append(found * (STEP / np.float32(4)))  # with the gate's two bits, which add less than a step
        gate <<= np.int16(2)
        found &= np.int16(3)
        gate |= found
    return [*x, np.float32(0.3)], gate.astype(np.intp)


def _refine(codes: Codes, dot: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Probability of a one from the mixer; half of it and half of the map's; the map's cells."""
    plain = _squash(dot)
    share = np.clip(dot, np.float32(-7.99), np.float32(7.99), out=dot)
    share *= np.float32(2)
    share += np.float32((APM - 1) / 2)
    cell = share.astype(np.int32)  # by way of 32 bits, as these casts are vectorised
    share -= cell.astype(np.float32)
    cell = cell.astype(np.intp)
    cell += long
    under = codes.apm.take(cell, mode="wrap")
    p = codes.apm[1:].take(cell, mode="wrap")
    p -= under
    p *= share
    p += under
    p += plain
    p *= np.float32(0.5)
    return plain, p, (cell, share)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.append(np.zeros(min(len(x), 1), np.intp), np.flatnonzero(x[1:] != x[:-1]) + 1)


@dataclass
class Group:
    """Some blocks in a row, and what no weight changes of their decisions, as many blocks are small. Those of a block
    come by document, and a document's words before the bytes of its spelled words (two parts)."""

    one: np.ndarray  # whether a decision is a one, as a number
    long: np.ndarray  # where its map begins
    x: list  # log-odds of each context and a constant
    gate: np.ndarray
    edges: list  # decisions, and documents of blocks, before each block
    docs: np.ndarray  # the documents of each block
    at: np.ndarray  # where their decisions begin in their block
    size: np.ndarray
    parts: tuple[np.ndarray, np.ndarray]  # where parts begin, and which of all texts' parts they are


def _groups(codes: Codes, s: Symbols, part_of: np.ndarray, edges: np.ndarray) -> Iterator[Group]:
    done = np.append(0, np.cumsum(s.bits))[edges]  # decisions before each block
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(done, done[i] + TOGETHER, side="right")) - 1)
        a, b = edges[i], edges[j]
        part = Symbols(s.code[a:b], s.bits[a:b], [c[a:b] for c in s.contexts], s.doc[a:b], s.block[a:b], s.letter[a:b])
        node, bit = _decisions(part)
        begin = np.cumsum(part.bits) - part.bits
        first = _changes(part_of[a:b])
        kinds = part.doc[first] * 2 + part.letter[first]
        own = first[_changes(part_of[a:b][first] >> 1)]
        at = begin[own]
        x, gate = _inputs(codes, part, node)
        long = (node > 255).view(np.int8) + (node > 1 << 14)
        long = long.astype(np.intp)
        long *= APM
        until, of = done[i : j + 1] - done[i], np.searchsorted(own, edges[i : j + 1] - a)
        yield Group(bit.astype(np.float32), long, x, gate, list(zip(until.tolist(), of.tolist(), strict=True)), part.doc[own], at - np.repeat(until[:-1], np.diff(of)), np.diff(np.append(at, len(node))), (begin[first], kinds))
        i = j


def _walk(codes: Codes, s: Symbols, n_docs: int, learn: bool) -> np.ndarray:
    """Log2 probability of each text's words and ends, and of the bytes of its spelled words: [texts, 2].
    Documents advance together, block by block; each starts from the common weights and follows its
    own errors. With learn, the common weights and the map follow too."""
    part_of = (s.block * n_docs + s.doc) * 2 + s.letter
    order = np.argsort(part_of, kind="stable")
    s = Symbols(s.code[order], s.bits[order], [c[order] for c in s.contexts], s.doc[order], s.block[order], s.letter[order])
    part_of = part_of[order]
    own = np.zeros((n_docs, len(SLOTS) + 1), np.float32)
    total = np.zeros(n_docs * 2)
    edges = np.append(_changes(s.block), len(s.block))
    with np.errstate(over="ignore"):  # odds beyond all bounds are those of no chance
        for g in _groups(codes, s, part_of, edges):
            chance = np.empty(len(g.one), np.float32)
            rate = (DOC_RATE / 8 / np.sqrt(16 + g.size)).astype(np.float32)[:, None]
            for k, ((low, from_doc), (high, to_doc)) in enumerate(pairwise(g.edges)):
                docs, at, size = g.docs[from_doc:to_doc], g.at[from_doc:to_doc], g.size[from_doc:to_doc]
                w = codes.weights.take(g.gate[low:high], axis=0, mode="wrap")
                mine = own[docs]
                w += mine.repeat(size, axis=0)
                x = [v[low:high] for v in g.x[:-1]]
                dot = w[:, -1] * g.x[-1]
                for c, v in enumerate(x):
                    v_ = w[:, c]
                    v_ *= v
                    dot += v_
                plain, p, (cell, share) = _refine(codes, dot, g.long[low:high])
                chance[low:high] = p
                error = g.one[low:high] - plain
                step = np.empty((len(docs), len(g.x)), np.float32)
                for c, v in enumerate(x):
                    v *= error  # they are not looked at again
                    np.add.reduceat(v, at, out=step[:, c])
                error *= g.x[-1]
                np.add.reduceat(error, at, out=step[:, -1])
                step *= rate[from_doc:to_doc]
                mine *= np.float32(0.98)
                mine += step
                own[docs] = mine
                if learn:
                    gate = g.gate[low:high]
                    rate_ = TUNE_RATE / np.sqrt(4 + np.bincount(gate, minlength=len(codes.weights)))
                    for c, v in enumerate([*x, error]):
                        codes.weights[:, c] += (rate_ * np.bincount(gate, v, len(rate_))).astype(np.float32)
                    _learn_map(codes.apm, cell, share, g.one[low:high])
            chance -= np.float32(1) - g.one
            np.abs(chance, out=chance)
            np.clip(chance, np.float32(1e-5), np.float32(1 - 1e-5), out=chance)
            begin, kinds = g.parts
            # within a block in 32 bits, between blocks in 64
            total += np.bincount(kinds, np.add.reduceat(np.log(chance, out=chance), begin) * LOG2_E, n_docs * 2)
    return total.reshape(n_docs, 2)


def _learn_map(apm: np.ndarray, cell: np.ndarray, share: np.ndarray, one: np.ndarray) -> None:
    """Moves the cells on either side of each decision to it, by its share of them: first those below, then those above."""
    key = cell * 2
    key += one.astype(np.intp)
    times, above = np.bincount(key, minlength=2 * len(apm)), np.bincount(key, share, 2 * len(apm))
    below = times - above
    for zeros, ones, cells in ((below[0::2], below[1::2], apm), (above[0:-2:2], above[1:-2:2], apm[1:])):
        both = zeros + ones
        cells += ((ones - both * cells) / (50 + both)).astype(np.float32)


def untuned(codes: Codes) -> None:
    codes.weights = np.full((GATES ** len(SLOTS), len(SLOTS) + 1), 0.35, np.float32)
    codes.weights[:, -1] = 0
    grid = (np.arange(APM) - (APM - 1) / 2) / 2
    codes.apm = np.tile(_squash(grid), 3).astype(np.float32)
    codes.apm = np.append(codes.apm, np.float32(0.5))


def _learn(codes: Codes, texts: pa.Array) -> None:
    _, s = tokens_of(texts, codes)
    _walk(codes, s, len(texts), True)


def tune(codes: Codes, texts: pa.Array) -> None:
    """Sets the common weights and the map, from texts that the tables have not seen."""
    untuned(codes)
    for _ in range(PASSES if len(texts) else 0):
        _learn(codes, texts)


def tuning_plan(n: int) -> tuple[int, int, int]:
    """Of n training documents, one in how many is tuned on (all are), in how many parts, each for a pass of
    its own, and in how many shards a part is."""
    return 1, PASSES, max(1, n // PASSES // TUNING)


def dealt(texts: DataFrame, parts: int, shards: int) -> DataFrame:
    """texts with the part and the shard of each row. Rows are dealt by their places too, so that one that is
    repeated many times isn't one shard."""
    row = F.xxhash64("__id", "__text", F.monotonically_increasing_id())
    part, shard = F.pmod(F.shiftrightunsigned(row, 48), F.lit(parts)), F.pmod(F.shiftrightunsigned(row, 32), F.lit(shards))
    return texts.withColumns({"__part": part, "__shard": shard})


def by_length(table: pa.Table) -> pa.Table:
    """A shard's rows by fold, those of like length together, as they advance together."""
    size = pa.compute.binary_length(table.column("__text"))
    return table.append_column("__size", size).sort_by([(c, "ascending") for c in ("__fold", "__size", "__id", "__text")])


def units(dealt: DataFrame, shards: int) -> DataFrame:
    """dealt with the unit of each row, whose rows are learned from in order. FOLDS shards or more trade their rows, so that
    as many units of a fold each come of them: then a unit looks up one fold's tables, and more of its texts are of like length."""
    groups = shards // FOLDS
    unit = F.col("__shard") if groups == 0 else F.pmod("__shard", F.lit(groups)) * FOLDS + F.col("__fold")
    return dealt.withColumn("__unit", unit)


def fit(train: DataFrame, id_col: str, text_col: str) -> tuple[Codes, DataFrame]:
    """The model, and the counts of all training words (__h, __c), stored."""
    spark = train.sparkSession
    bounded_batches(spark)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, letters = [], 0, np.zeros(256, np.int64)
        for batch in chain(batches, (None,)):
            for piece in slices(batch, "__text") if batch is not None else ():
                h, _ = common.word_hashes(piece.column("__text"))
                parts += [h, np.full(piece.num_rows, END, U)]
                held += len(h)
                raw = common.lowered(common.buffer_of(piece.column("__text"))[0])
                letters += np.bincount(np.where(common._WHITE[raw], np.uint8(32), raw), minlength=256)
            if parts and (held > COUNTED or batch is None):
                h, c = np.unique(np.concatenate(parts), return_counts=True)
                own = np.flatnonzero(letters)
                kind = np.repeat([False, True], [len(h), len(own)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.append(h.view(np.int64), own)), pa.array(np.append(c, letters[own]).astype(np.int64))], names=["__byte", "__h", "__c"])
                parts, held, letters = [], 0, np.zeros(256, np.int64)

    texts = train.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    both = stored_alone(spark, texts.select("__text").mapInArrow(words, "__byte boolean, __h long, __c long").groupBy("__byte", "__h").agg(F.sum("__c").alias("__c")), "counts")
    counts = both.filter("not __byte").select("__h", "__c")
    letters = np.zeros(256)
    for byte, count in both.filter("__byte").select("__h", "__c").collect():
        letters[byte] = count
    with alone(spark):
        n, v = counts.agg(F.coalesce(F.sum("__c"), F.lit(0)), F.count(F.lit(1))).first()
        top = counts.filter(F.col("__c") >= LEAST).orderBy(F.desc("__c"), "__h").limit(VOCABULARY).toPandas()
        _, parts_, shards = tuning_plan(texts.count())

    key = F.xxhash64("__id", "__text")  # copies of a row are of one fold, so none is tuned on with tables that hold another
    texts = texts.withColumn("__fold", F.pmod(F.shiftrightunsigned(key, 20), F.lit(FOLDS)).cast("int"))
    codes = make_codes(top["__h"].to_numpy().view(U), top["__c"].to_numpy(), int(n), int(v), letters)
    bare = spark.sparkContext.broadcast(codes)  # bounded by VOCABULARY

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        counts_ = [[np.zeros(2 << k, np.int32) for k in SLOTS] for _ in range(FOLDS)]
        held: dict[int, list] = {}  # texts of the folds, until there are some

        def settle(fold: int) -> None:
            texts = pa.RecordBatch.from_arrays([pa.concat_arrays(held.pop(fold))], names=["__text"])
            for piece in slices(texts, "__text", GATHER):
                count_into(counts_[fold], piece.column("__text"), bare.value)

        for batch in batches:
            folds = batch.column("__fold").to_numpy()
            for fold in np.unique(folds).tolist():
                own = held.setdefault(fold, [])
                own.append(batch.column("__text").filter(pa.array(folds == fold)))
                if sum(x.nbytes for x in own) > GATHER:
                    settle(fold)
        for fold in sorted(held):
            settle(fold)
        for fold in range(FOLDS):
            for c, total in enumerate(counts_[fold]):
                for i, piece in enumerate(total.reshape(-1, 2 * PIECE)):
                    if piece.any():
                        yield pa.RecordBatch.from_arrays([pa.array([c * 10_000 + i]), pa.array([fold], pa.int32()), *(pa.array([x], pa.binary()) for x in packed(piece))], names=["__piece", "__fold", "__at", "__counts", "__more"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece of the tables of all documents, and of those without each fold, one after another."""
        total = np.zeros((FOLDS, 2 * PIECE), np.int64)
        for batch in batches:
            for fold, *parts in zip(batch.column("__fold").to_pylist(), *(batch.column(c) for c in ("__at", "__counts", "__more")), strict=True):
                unpacked_into(total[fold], *(x.as_buffer() for x in parts))
        whole = total.sum(axis=0)
        made = tables_of([whole, *(whole - own for own in total)])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.concatenate(made).tobytes()], pa.binary())], names=["__piece", "__tables"])

    with alone(spark):
        gathered = texts.select("__text", "__fold").mapInArrow(gather, "__piece long, __fold int, __at binary, __counts binary, __more binary").groupBy("__piece").applyInArrow(add, "__piece long, __tables binary").collect()  # as many rows as the tables have pieces, at most
    made = [[np.zeros(1 << k, np.int16) for k in SLOTS] for _ in range(FOLDS + 1)]
    for piece, raw in gathered:
        c, i = divmod(piece, 10_000)
        for own, part in zip(made, np.frombuffer(raw, np.int16).reshape(FOLDS + 1, PIECE), strict=True):
            own[c][i * PIECE : (i + 1) * PIECE] = part
    codes.tables = made[0]
    untuned(codes)
    without = spark.sparkContext.broadcast(made[1:])  # of fixed size

    # A unit's documents are learned from in order, one fold after another and short ones first; the units' weights are averaged after each pass.
    tuned = units(dealt(texts, parts_, shards), shards)

    def average(table: pa.Table) -> pa.Table:
        """Of some shards' states, the sum and what it counts for."""
        rows = sorted((n, x.as_buffer().to_pybytes()) for n, x in zip(table.column("__n").to_pylist(), table.column("__state"), strict=True))
        total = sum(n * np.frombuffer(x, np.float32).astype(np.float64) for n, x in rows)
        return pa.table({"__n": pa.array([sum(n for n, _ in rows)]), "__state": pa.array([total.tobytes()], pa.binary())})

    for k in range(PASSES):
        state = (codes.weights, codes.apm)

        def learn(table: pa.Table) -> pa.Table:
            keep_memory()
            mine = replace(bare.value, weights=state[0].copy(), apm=state[1].copy())
            table = by_length(table)
            for fold in pa.compute.unique(table.column("__fold")).to_pylist():
                mine.tables = without.value[fold]
                rows = table.filter(pa.compute.equal(table.column("__fold"), fold)).combine_chunks()
                for batch in rows.to_batches():
                    for piece in slices(batch, "__text", TUNED, TUNED_ROWS):
                        _learn(mine, piece.column("__text"))
            return pa.table({"__unit": table.column("__unit").slice(0, 1), "__n": pa.array([table.num_rows]), "__state": pa.array([np.append(mine.weights, mine.apm).tobytes()], pa.binary())})

        with alone(spark):
            states = tuned.filter(F.col("__part") == k % parts_).groupBy("__unit").applyInArrow(learn, "__unit long, __n long, __state binary")
            found = states.groupBy(F.pmod("__unit", F.lit(AVERAGES))).applyInArrow(average, "__n long, __state binary").collect()
        if found:
            found.sort(key=lambda r: (r["__n"], bytes(r["__state"])))
            mean = (sum(np.frombuffer(r["__state"], np.float64) for r in found) / sum(r["__n"] for r in found)).astype(np.float32)
            codes.weights, codes.apm = mean[: state[0].size].reshape(state[0].shape).copy(), mean[state[0].size :].copy()
    return codes, counts


def score(docs: DataFrame, codes: Codes, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __bytes, __n_tokens, __n_known, __base, __score, __spelled of each row (log10).

    __score is the probability of the text's tokens, among the base's V + 1 events: each word seen in
    training, and any other. __spelled is that of its bytes: words without codes are spelled.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(codes)  # of fixed size

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        keep_memory()
        each = np.append(np.log10((own.counts + 0.5) / (own.n + 0.5 * (own.v + 1))), 0.0)
        for batch in batches:
            # Texts of like length together, as they advance together.
            batch = batch.take(pa.array(np.argsort(np.diff(common.buffer_of(batch.column("__text"))[1]), kind="stable")))
            for piece in slices(batch, "__text", CHUNK, SCORED_ROWS):
                t, s = tokens_of(piece.column("__text"), own)
                n = piece.num_rows
                logs = _walk(own, s, n, False) * np.log10(2)
                doc = np.repeat(np.arange(n), np.diff(t.splits))
                base = np.bincount(doc, each[t.index], n)
                known = np.bincount(doc, t.known, n).astype(np.int64)
                rare = ~t.known
                pairs, k = np.unique(np.stack([doc[rare].astype(U), t.hashes[rare]], axis=1), axis=0, return_counts=True) if rare.any() else (np.zeros((0, 2), U), np.zeros(0, np.int64))
                ends = np.searchsorted(pairs[:, 0], np.arange(n + 1, dtype=np.int64).astype(U))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(pairs[:, 1].copy().view(np.int64)), pa.array(k.astype(np.int64))], names=["h", "k"]))
                sizes = np.diff(common.buffer_of(piece.column("__text"))[1])
                yield pa.RecordBatch.from_arrays([piece.column("__id"), pa.array(sizes), pa.array(np.diff(t.splits)), pa.array(known), pa.array(base), pa.array(logs[:, 0]), pa.array(logs.sum(axis=1)), lists], names=["__id", "__bytes", "__n_tokens", "__n_known", "__base", "__words", "__spelled", "__rare"])

    schema = "__id long, __bytes long, __n_tokens long, __n_known long, __base double, __words double, __spelled double, __rare array<struct<h: long, k: long>>"
    first = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).mapInArrow(go, schema)
    # Stored, so that the number given to each row holds for both uses.
    scored = stored_alone(spark, first.withColumn("__row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("__row", F.inline("__rare")).join(counts.withColumnRenamed("__h", "h"), "h", "left")
    c = F.coalesce(F.col("__c"), F.lit(0))
    # Words without codes: the base charges them among all words, the model among themselves behind the escape.
    summed = rare.groupBy("__row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("__logs"), F.sum("k").alias("__k"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("__seen"))
    n_rare, v_rare = codes.n - int(codes.counts.sum()), codes.v - len(codes.words)
    among = lambda n, v: F.coalesce(F.col("__logs") - F.col("__k") * F.log10(F.lit(n + 0.5 * (v + 1))), F.lit(0.0))
    return scored.join(summed, "__row", "left").select(
        "__id", "__bytes", "__n_tokens", (F.col("__n_known") + F.coalesce("__seen", F.lit(0))).alias("__n_known"),
        (F.col("__base") + among(codes.n, codes.v)).alias("__base"), (F.col("__words") + among(n_rare, v_rare)).alias("__score"), "__spelled",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codes, counts = fit(docs.filter(~in_bucket("doc_id", 5, 1)), "doc_id", "text")
    out = score(docs, codes, counts)
    bits = -F.col("__spelled") / F.log10(F.lit(2.0)) / F.greatest(F.col("__bytes"), F.lit(1))
    return out.select(F.col("__id").alias("doc_id"), in_bucket("__id", 5, 1).alias("held_out"), F.col("__n_tokens").alias("n_tokens"), F.col("__n_known").alias("n_known"), F.lit(codes.n).cast("long").alias("train_tokens"), F.col("__base").alias("base_score"), F.col("__score").alias("score"), F.col("__spelled").alias("spelled_score"), bits.alias("bits_per_byte"))
