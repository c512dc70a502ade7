"""N-gram Jaccard join by signature trees, exact, giving classes of linked documents.

A document is the set of its word n-grams. Equal sets are one set from the start. Two sets
whose similarity reaches the threshold share one of their rarest members: each set is entered
under a prefix of its members in order of rarity, and sets under one member form a bucket.

First each bucket's sets are held against the one of the commonest members, which links most
copies at a cost in proportion to the rows; classes are formed from the links. What is left are
pairs of sets of one bucket in different classes. Those are found by signature trees: a leaf
holds a few sets; a node holds the OR of its sets' bitmaps and the range of their sizes. Two
trees are walked at once, and a pair of nodes goes when its largest possible overlap is too
small, or when all its sets are of one class already. Every pair found is checked on its sets.
Buckets too large for a task are cut into groups, and a task holds two of them: each two groups of
sets outside the bucket's largest class meet once, and each of them meets each group of that class,
whose own sets need not meet each other. So a task's rows are bounded whatever the bucket.

Rarity comes from a sketch of fixed size over all documents; only the order of members hangs on
it, never the result. Sets are named by 64-bit fingerprints, members by 64-bit hashes.

Defined cases: fewer words than n make one member of the whole sequence; null and empty texts
have an empty set, which is linked with nothing. Rows that repeat an id with different texts
are different sets under one id. Null ids never name a class unless all its ids are null.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import U, bounded_batches, dropped, mix, shingle_hashes, slices, stored, table, word_hashes
from morphlake.llm.graph import components

WIDTH, PERCENT = 4, 85
#: Counters of the sketch of how many documents have a member, and those of one row of its shuffle.
SKETCH, PIECE = 1 << 22, 1 << 16
#: Steps of the sketch's counters in a doubling.
LEVELS = 1024
#: Bits of a set's bitmap in trees; sets of a leaf; sets of a group of a bucket, about.
BITS, LEAF, BLOCK = 1024, 16, 512
#: Rows of ids that may be broadcast (16 bytes each, so 8 MB); beyond it, texts are shuffled to them.
BROADCAST_ROWS = 500_000


def sets_of(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a batch."""
    out = []
    for piece in slices(batch, "__text"):
        words, splits = word_hashes(piece.column("__text"))
        grams, ends = shingle_hashes(words, splits, width)
        out += [np.unique(grams[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(x).sum() + U(len(x)) if len(x) else U(0) for x in sets], U)).view(np.int64)


def bitmap(members: np.ndarray) -> bytes:
    """A bit for each member: BITS, or about twice as many as there are members, if that is more."""
    size = max(BITS, 1 << int(2 * len(members)).bit_length())
    bits = np.zeros(size, bool)
    bits[(members >> U(20)).astype(np.int64) & (size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of a longer bitmap as bitmaps of so many 64-bit words: the one that as many bits would have made."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def prefix(members: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The rarest members, so many that similar sets must share one of them."""
    n = len(members)
    keep = n - (percent * n + 99) // 100 + 1
    rank = sketch[(members & U(SKETCH - 1)).astype(np.int64)].astype(U) << U(48) | members >> U(16)
    return members[np.argsort(rank, kind="stable")[:keep]]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def similar_pairs(sizes: np.ndarray, bitmaps: np.ndarray, classes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (row of left, row of right) that may be similar and are of different classes,
    by walking the signature trees of both sides. Equal sides give each pair once."""
    same = left is right
    trees = [_tree(sizes, bitmaps, classes, left)]
    trees.append(trees[0] if same else _tree(sizes, bitmaps, classes, right))
    found: list[np.ndarray] = []
    stack = [(trees[0], trees[1])]
    while stack:
        a, b = stack.pop()
        if a["class"] >= 0 and a["class"] == b["class"]:
            continue
        if 100 * min(a["high"], b["high"]) < percent * max(a["low"], b["low"]):
            continue
        # every set under a has the bits of a's AND; those that no set of b has are members lost
        lost = max(int(np.bitwise_count(a["all"] & ~b["any"]).sum()), 0)
        gone = max(int(np.bitwise_count(b["all"] & ~a["any"]).sum()), 0)
        most = min(a["high"] - lost, b["high"] - gone)
        if 100 * most < percent * max(a["low"], b["low"]):
            continue
        if a["kids"] or b["kids"]:
            if a["kids"] and (not b["kids"] or a["size"] >= b["size"]):
                if a is b:
                    kids = a["kids"]
                    stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
                else:
                    stack += [(x, b) for x in a["kids"]]
            else:
                stack += [(a, x) for x in b["kids"]]
            continue
        p, q = np.meshgrid(a["rows"], b["rows"], indexing="ij")
        p, q = p.ravel(), q.ravel()
        if a is b:
            p, q = p[p < q], q[p < q]
        found.append(np.stack([p, q], axis=1)[_may(sizes, bitmaps, classes, p, q, percent)])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _room(na, nb, a, b, percent) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can be similar."""
    lost = np.bitwise_count(a & ~b).sum(axis=1).astype(np.int64)
    gone = np.bitwise_count(b & ~a).sum(axis=1).astype(np.int64)
    both = np.minimum(na - lost, nb - gone)
    return 100 * both >= percent * (na + nb - both)


def _may(sizes, bitmaps, classes, p, q, percent) -> np.ndarray:
    return (classes[p] != classes[q]) & _room(sizes[p], sizes[q], bitmaps[p], bitmaps[q], percent)


def _tree(sizes, bitmaps, classes, rows) -> dict:
    """Rows by size, then bitmap; leaves of LEAF rows; nodes of eight children."""
    order = rows[np.lexsort((bitmaps[rows, 1], bitmaps[rows, 0], classes[rows], sizes[rows]))]
    level = []
    for i in range(0, len(order), LEAF):
        own = order[i : i + LEAF]
        level.append({"rows": own, "kids": [], "size": len(own), "low": int(sizes[own].min()), "high": int(sizes[own].max()), "any": np.bitwise_or.reduce(bitmaps[own]), "all": np.bitwise_and.reduce(bitmaps[own]), "class": int(classes[own[0]]) if (classes[own] == classes[own[0]]).all() else -1})
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 8):
            kids = level[i : i + 8]
            above.append({"rows": None, "kids": kids, "size": sum(x["size"] for x in kids), "low": min(x["low"] for x in kids), "high": max(x["high"] for x in kids), "any": np.bitwise_or.reduce([x["any"] for x in kids]), "all": np.bitwise_and.reduce([x["all"] for x in kids]), "class": kids[0]["class"] if len({x["class"] for x in kids}) == 1 else -1})
        level = above
    return level[0]


def _group_pairs(task: np.ndarray, same: np.ndarray, side: np.ndarray, sizes, bitmaps, classes, percent) -> np.ndarray:
    """Pairs of rows of both sides of each task (sorted), or of one group with itself, by trees."""
    starts = np.flatnonzero(np.diff(task, prepend=task[0] - 1))
    found = [np.zeros((0, 2), np.int64)]
    for a, b in zip(starts, np.append(starts[1:], len(task)), strict=True):
        rows = np.arange(a, b)
        left, right = rows[side[a:b] == 0], rows[side[a:b] == 1]
        if same[a]:
            right = left
        if len(left) and len(right):
            found.append(similar_pairs(sizes, bitmaps, classes, left, right, percent))
    return np.concatenate(found)


def _sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Levels (LEVELS to a doubling) of how many times members of each hashed class occur: 2 * SKETCH bytes,
    whatever the input. The levels are so fine that a member stands out by the times it occurs itself,
    also where its class is full of others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int32)
        for batch in batches:
            for x in slices(batch, "__text"):
                words, splits = word_hashes(x.column("__text"))
                grams, _ = shingle_hashes(words, splits, width)
                np.add.at(total, (grams & U(SKETCH - 1)).astype(np.intp), np.int32(1))
        for i, part in enumerate(total.reshape(-1, PIECE)):
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["k", "at", "c"])

    def level(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PIECE, np.int64)
        for batch in batches:
            for at, c in zip(batch.column("at"), batch.column("c"), strict=True):
                total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(c.as_buffer(), np.int32)
        levels = np.minimum(LEVELS * np.log2(1 + total), 65535).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["k", "levels"])

    rows = texts.select("__text").mapInArrow(count, "k int, at binary, c binary").groupBy("k").applyInArrow(level, "k int, levels binary")
    out = np.zeros((SKETCH // PIECE, PIECE), np.uint16)
    for k, levels in rows.collect():  # 2 * SKETCH bytes in all
        out[k] = np.frombuffer(levels, np.uint16)
    return out.reshape(-1)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("members").alias("__ma")), "a").join(sets.select(F.col("sid").alias("b"), F.col("members").alias("__mb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(batch.column("__ma"), batch.column("__mb"), strict=True)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return both.select("a", "b", "__ma", "__mb").mapInArrow(check, "a long, b long")


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave room for similarity. The bitmaps of long sets
    are longer, so that sets that only share a few members are told apart at any length."""
    one, two = (bits.select(F.col("sid").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"b{e}")) for e in ("a", "b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ba, bb = (batch.column(c).to_pylist() for c in ("ba", "bb"))
            wide = np.array([(len(x), len(y)) for x, y in zip(ba, bb, strict=True)], np.int64).reshape(-1, 2)
            ok = np.zeros(batch.num_rows, bool)
            for u, v in np.unique(wide, axis=0).tolist():
                at = np.flatnonzero((wide == (u, v)).all(axis=1))
                x, y = (folded(np.frombuffer(b"".join([l[i] for i in at]), U).reshape(len(at), -1), min(u, v) // 8) for l in (ba, bb))
                ok[at] = _room(na[at], nb[at], x, y, percent)
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.join(one, "a").join(two, "b").filter(close).select("a", "b", "na", "nb", "ba", "bb").mapInArrow(keep, "a long, b long")


def _classes(old: DataFrame, edges: DataFrame) -> DataFrame:
    """(sid, comp) after links between classes."""
    between = edges.join(old.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), "a").join(old.select(F.col("sid").alias("b"), F.col("comp").alias("cb")), "b")
    joined = components(between.select("ca", "cb"), "ca", "cb")
    new = old.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("__new")), "comp", "left")
    return stored(old.sparkSession, new.select("sid", F.coalesce("__new", "comp").alias("comp")), "classes")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """__id, __hash, __n, __class, __component of each row: the hash of its text (xxhash64), the size of its set and
    the least id of its class."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    ranks = spark.sparkContext.broadcast(_sketch(texts, width))  # 2 * SKETCH bytes

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies have a bitmap once a task
        for batch in batches:
            sets = sets_of(batch, width)
            names = fingerprints(sets)
            bits = [None if not len(x) or k in seen or seen.add(k) else bitmap(x) for k, x in zip(names.tolist(), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__hash"), pa.array(names), pa.array([len(x) for x in sets], pa.int64()), pa.array(bits, pa.binary())], names=["__id", "__hash", "sid", "n", "bits"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies enter once a task
        for batch in batches:
            sets = sets_of(batch, width)
            names = fingerprints(sets)
            new = [i for i, x in enumerate(names.tolist()) if not (x in seen or seen.add(x))]
            names, sets = names[new], [sets[i] for i in new]
            made = [prefix(x, ranks.value, percent) if len(x) else x for x in sets]
            sizes = np.array([len(x) for x in made], np.int64)
            token = np.concatenate([np.zeros(0, U), *made]).view(np.int64)
            n = np.array([len(x) for x in sets], np.int32)
            # How common a set's members are: in a family of copies, highest for the one they were made from.
            common = np.array([int(ranks.value[(x & U(SKETCH - 1)).astype(np.int64)].mean() / 2) if len(x) else 0 for x in sets], np.int16)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(names, sizes)), pa.array(np.repeat(n, sizes)), pa.array(np.repeat(common, sizes))], names=["token", "sid", "n", "common"])

    named = stored(spark, texts.withColumn("__hash", F.xxhash64("__text")).mapInArrow(name, "__id long, __hash long, sid long, n long, bits binary"), "named")
    entries = texts.select("__text").mapInArrow(enter, "token long, sid long, n int, common short")
    leaders = entries.groupBy("token").agg(F.max(F.struct("common", "sid", "n")).alias("lo"), F.min("sid").alias("least"), F.max("sid").alias("most")).filter("least <> most")
    # Stored, so that the join deals both sides anew and a hot member's rows can be split.
    leaders = stored(spark, leaders.select("token", "lo"), "leaders")
    close = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    buckets = stored(spark, entries.drop("common").join(leaders, "token"), "buckets")
    apart = buckets.filter((F.col("sid") != F.col("lo.sid")) & close(F.col("n"), F.col("lo.n")))
    pairs = stored(spark, apart.select(F.least("sid", "lo.sid").alias("a"), F.greatest("sid", "lo.sid").alias("b")).distinct(), "pairs")

    # The sets that lie in any shared bucket, with one document each. Rows of copies are merged before the join.
    each = named.filter("n > 0").groupBy("sid").agg(F.min("__id").alias("__id"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    bits = stored(spark, each.join(buckets.select("sid").distinct(), "sid", "left_semi"), "bits")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        seen: set[int] = set()  # a repeated id brings its rows again: once a task is enough
        for batch in batches:
            sets = sets_of(batch, width)
            names = fingerprints(sets)
            new = [i for i, x in enumerate(names.tolist()) if not (x in seen or seen.add(x))]
            yield names[new], [sets[i] for i in new]

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in once(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in sets], pa.binary())], names=["sid", "members"])

    def texts_of(sids: DataFrame) -> DataFrame:
        """The text of one document of each set."""
        n = sids.limit(BROADCAST_ROWS + 1).count()
        ids = sids.select(F.col("__id").alias("__want"))
        ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
        return texts.join(ids, F.col("__id").eqNullSafe(F.col("__want")), "left_semi").select("__text")

    def linked(found: DataFrame) -> DataFrame:
        """The pairs that are similar: only their sets are made and sent."""
        found = stored(spark, _possible(found, bits, percent), "possible")
        sids = found.select(F.col("a").alias("sid")).unionAll(found.select(F.col("b").alias("sid"))).distinct()
        needed = stored(spark, bits.select("sid", "__id").join(sids, "sid"), "needed")
        sets = stored(spark, texts_of(needed).mapInArrow(hold, "sid long, members binary"), "sets")
        links = stored(spark, _verified(found, sets, percent), "links")
        dropped(found, needed, sets)
        return links

    classes = bits.select("sid", F.col("sid").alias("comp"))
    links = linked(pairs)
    classes = _classes(classes, links)
    dropped(pairs, links, leaders)

    # Buckets that still hold several classes; the largest class of each comes first.
    rows = stored(spark, buckets.select("token", "sid", "n").distinct().join(classes, "sid"), "rows")
    dropped(buckets)
    mixed = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main")).filter("kinds > 1")
    mixed = stored(spark, mixed, "mixed")
    placed = stored(spark, rows.join(mixed, "token"), "placed")
    dropped(rows, mixed)
    # A bucket no larger than a leaf is a tree of one leaf: its pairs are listed and held against the bitmaps.
    leaf = placed.filter(F.col("all") <= LEAF).groupBy("token").agg(F.collect_list(F.struct("sid", "n", "comp")).alias("l"))
    listed = leaf.select(F.inline(F.expr(f"flatten(transform(l, x -> transform(filter(l, y -> y.sid > x.sid AND y.comp <> x.comp AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}), y -> struct(x.sid AS a, y.sid AS b))))"))).distinct()
    # Groups of the largest class and of all other sets of a bucket; a task is (token, a, b), where b under 0 is a group of that class.
    groups = lambda n: F.ceil(n / BLOCK).cast("int")
    laid = placed.filter(F.col("all") > LEAF).select("token", "sid", "n", "comp", (F.col("comp") == F.col("main")).alias("first"), groups(F.col("most")).alias("of_main"), groups(F.col("all") - F.col("most")).alias("of_rest"))
    laid = laid.withColumn("own", F.pmod(F.xxhash64("sid"), F.when(F.col("first"), F.col("of_main")).otherwise(F.col("of_rest"))).cast("int"))
    own, each = F.col("own"), lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    rest, main = each(F.col("of_rest")), each(F.col("of_main"))
    every = F.when(F.col("first"), F.transform(rest, lambda i: place(i, -1 - own, 1))).otherwise(
        F.concat(
            F.transform(F.filter(rest, lambda j: j >= own), lambda j: place(own, j, 0)),
            F.transform(F.filter(rest, lambda j: j < own), lambda j: place(j, own, 1)),
            F.transform(main, lambda k: place(own, -1 - k, 0)),
        )
    )
    laid = laid.join(bits.select("sid", "bits"), "sid").select("token", "sid", "n", "comp", "bits", F.inline(every))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in chain(batches, (None,)):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                left = pa.concat_tables([left, now]).combine_chunks() if left is not None else now
                if not left.num_rows:
                    continue
                token, a, b = (left.column(c).to_numpy() for c in ("token", "a", "b"))
                edge = np.flatnonzero((token != token[-1]) | (a != a[-1]) | (b != b[-1]))
                cut = int(edge[-1]) + 1 if len(edge) else 0  # the last group may go on
                now, left = left.slice(0, cut), left.slice(cut)
            else:
                now, left = left, None
            if now is None or not now.num_rows:
                continue
            token, a, b, side, sid, n, comp = (now.column(c).to_numpy() for c in ("token", "a", "b", "side", "sid", "n", "comp"))
            task = np.cumsum(np.append(0, (np.diff(token) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)))
            bits = np.concatenate([folded(np.frombuffer(x.as_buffer(), U)[None], BITS // 64) for x in now.column("bits")])
            kinds = np.unique(comp, return_inverse=True)[1].astype(np.int64)
            got = _group_pairs(task, a == b, side, n.astype(np.int64), bits, kinds, percent)
            one, two = sid[got[:, 0]], sid[got[:, 1]]
            found = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = laid.repartition(parts, "token", "a", "b").sortWithinPartitions("token", "a", "b", "sid")
    more = stored(spark, dealt.select("token", "a", "b", "side", "sid", F.col("n").cast("long").alias("n"), "comp", "bits").mapInArrow(meet, "a long, b long").unionAll(listed).distinct(), "pairs")
    links = linked(more)
    classes = _classes(classes, links)
    dropped(placed, more, links, bits)

    out = named.join(classes, "sid", "left").select("__id", "__hash", F.col("n").alias("__n"), F.when(F.col("n") > 0, F.coalesce("comp", "sid")).alias("__class"))
    least = out.filter("__class is not null").groupBy("__class").agg(F.min("__id").alias("__least"))
    # Stored, so that the join deals both sides anew and a hot class can be split.
    least = stored(spark, least, "least")
    return out.join(least, "__class", "left").select("__id", "__hash", "__n", "__class", F.coalesce("__least", "__id").alias("__component"))


def query(spark, sf_dir: str) -> DataFrame:
    out = link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("__id").alias("doc_id"), F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"))
