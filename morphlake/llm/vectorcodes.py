"""Vectors as codes of four bytes: each quarter of a vector is replaced by its nearest of 256 codebook entries.

Components become whole numbers. A codebook starts as the quarters of the vectors with the smallest ids.
In each round every task gets the codebooks as kd-trees, finds the nearest entry of each quarter by
branch and bound, and sums the quarters of each entry; the sums, a row an entry and task, are added up and
give the next codebook. A node is visited if its box is no farther than the best entry so far, so a node at equal
distance is visited too and the lowest index wins ties. All numbers are whole and exact, so results do not hang on
how rows are dealt.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; null ids are kept
and stand last; rows that repeat an id are each a row and enter the first codebook in order of their
vectors. Shorter vectors are filled with zeros to the longest, and that to a multiple of four. With fewer than 256
rows the codebooks have that many entries. Components are held within what keeps a vector's error in 64 bits: for
64 components 2^27, which is a component of 131,072. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm.common import bounded_batches, stored_alone, table
from morphlake.llm.vectors import EXACT, add_groups, matrix, sound

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf at most.
LEAF = 16


@dataclass
class Node:
    """A box around some entries. A leaf holds their indexes in ascending order."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    axis: int = 0
    split: float = 0
    left: Node | None = None
    right: Node | None = None


class Tree:
    """A kd-tree over the entries of a codebook: boxes are halved at the median of their widest side."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._node(np.arange(len(points)))

    def _node(self, at: np.ndarray) -> Node:
        p = self.points[at]
        node = Node(p.min(0), p.max(0))
        wide = node.high - node.low
        if len(at) <= LEAF or not wide.any():
            node.entries = at
            return node
        node.axis = int(wide.argmax())
        values = np.sort(p[:, node.axis])
        node.split = values[(len(at) - 1) // 2]
        if node.split == values[-1]:  # more than half are equal to the largest
            node.split = values[values < values[-1]][-1]
        below = p[:, node.axis] <= node.split
        node.left, node.right = self._node(at[below]), self._node(at[~below])
        return node

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query, the lowest of equals, and its squared distance."""
        exact = 4 * float(max(np.abs(q).max(initial=0), np.abs(self.points).max(initial=0))) ** 2 * max(q.shape[1], 1) < EXACT
        kind = np.float64 if exact else np.int64
        best = _Best(q.astype(kind), self.points.astype(kind))
        self._descend(self.root, np.arange(len(q)), best)
        best.own = best.leaf.copy()
        self._visit(self.root, np.arange(len(q)), best)
        return best.index, best.distance.astype(np.int64)

    def _descend(self, node: Node, at: np.ndarray, best: _Best) -> None:
        """Each query first looks at the leaf that it falls into."""
        if not len(at):
            return
        if node.entries is not None:
            best.look(node, at)
            return
        below = best.q[at, node.axis] <= node.split
        self._descend(node.left, at[below], best)
        self._descend(node.right, at[~below], best)

    def _visit(self, node: Node, at: np.ndarray, best: _Best) -> None:
        """The nodes that may hold an entry as near as the best."""
        q = best.q[at]
        off = np.maximum(np.maximum(node.low.astype(q.dtype) - q, q - node.high.astype(q.dtype)), 0)
        at = at[np.einsum("ij,ij->i", off, off) <= best.distance[at]]
        if not len(at):
            return
        if node.entries is not None:
            best.look(node, at[best.own[at] != node.entries[0]])
            return
        self._visit(node.left, at, best)
        self._visit(node.right, at, best)


class _Best:
    def __init__(self, q: np.ndarray, points: np.ndarray):
        self.q, self.points = q, points
        self.sizes, self.lengths = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", points, points)
        self.index = np.full(len(q), len(points), np.int64)
        self.distance = np.full(len(q), np.inf if q.dtype == np.float64 else np.iinfo(np.int64).max, q.dtype)
        self.leaf = np.zeros(len(q), np.int64)  # first entry of the leaf that a query fell into
        self.own = self.leaf

    def look(self, node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        d = self.lengths[node.entries] - 2 * (self.q[at] @ self.points[node.entries].T) + self.sizes[at, None]
        i = d.argmin(1)  # the first of equals
        d, i = d[np.arange(len(at)), i], node.entries[i]
        better = (d < self.distance[at]) | ((d == self.distance[at]) & (i < self.index[at]))
        self.distance[at[better]], self.index[at[better]] = d[better], i[better]
        self.leaf[at] = node.entries[0]


def prepared(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """id, label and whole components of the rows that take part, stored; and the width of a part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter(sound(F.col("v")))
    longest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    width = max(1, -(-longest // parts))
    most = float(int((2.0**62 / (width * parts)) ** 0.5 / 2))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-most)), F.lit(most))).cast("int"))
    return stored_alone(vectors.sparkSession, rows.select("id", "label", whole.alias("v")), "whole"), width


def first_codebooks(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """[part, entry, position] of the vectors with the smallest ids: at most `entries` rows reach the driver."""
    top = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()
    return matrix(top.column("v"), width * parts, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)


def _quarters(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    return matrix(batch.column("v"), width * parts, np.int64).reshape(-1, parts, width)


def next_codebooks(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean."""
    parts, n, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        counts, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for b in batches:
            q = _quarters(b, parts, width)
            for p in range(parts):
                add_groups(counts[p], sums[p], trees[p].nearest(q[:, p])[0], q[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].ravel()))], ["p", "e", "n", "s"])

    each = rows.select("v").mapInArrow(summed, "p int, e int, n bigint, s array<bigint>")
    wide = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    after = books.copy()
    for r in each.groupBy("p", "e").agg(F.sum("n").alias("n"), *wide).collect():  # a row an entry
        after[r.p, r.e] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return after


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_codebooks(rows, width, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = next_codebooks(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of prepared rows."""
    parts, _, width = books.shape
    schema = T.StructType([*rows.select("id", "label").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books if len(b)]
        for b in (b for b in batches if b.num_rows):
            q = _quarters(b, parts, width)
            found = [trees[p].nearest(q[:, p]) for p in range(parts)]
            code = np.ascontiguousarray(np.stack([i for i, _ in found], 1).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([x.tobytes().hex() for x in code], pa.string()), pa.array(sum(d for _, d in found))], ["id", "label", "code", "error"])

    return rows.mapInArrow(coded, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of all rows (id, label, code, error), stored, and the codebooks [part, entry, position]."""
    bounded_batches(vectors.sparkSession)
    rows, width = prepared(vectors, id_col, label_col, vector_col, scale, PARTS)
    books = fit(rows, width)
    return stored_alone(vectors.sparkSession, encode(rows, books), "codes"), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """The codes' rows with `approx`, the whole components that each code stands for."""
    schema = T.StructType([*codes.schema, T.StructField("approx", T.ArrayType(T.LongType()))])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(len(books))
        for b in batches:
            at = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), np.uint8).reshape(-1, len(books))
            flat = books[parts[None, :], at].reshape(len(at), -1)
            ends = pa.array(np.arange(len(at) + 1) * flat.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], [*b.schema.names, "approx"])

    return codes.mapInArrow(back, schema)


def query(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    sums = stored_alone(spark, codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "__label")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another."""
    square = "CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    sql = """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (
  SELECT uid, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM v, range(4) t(part)
), c0 AS MATERIALIZED (
  SELECT part, entry, x FROM q JOIN (SELECT uid, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS entry FROM v QUALIFY entry < 256) USING (uid)
)"""
    near = lambda i: f""", n{i} AS MATERIALIZED (
  SELECT uid, part, any_value(x) AS x, min({{'d': d, 'i': entry}}) AS best FROM (SELECT q.uid, q.part, q.x, c.entry, {square} AS d FROM q JOIN c{i} c ON q.part = c.part) GROUP BY uid, part
)"""  # noqa: E731
    for i in range(ROUNDS):
        sql += near(i) + f""", c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY place) AS x FROM (
      SELECT part, best.i AS entry, place, CAST(sum(x[place]) AS BIGINT) AS s, count(*) AS n FROM n{i}, range(1, 4097) t(place) WHERE place <= len(x) GROUP BY 1, 2, 3) GROUP BY 1, 2
  ) m ON m.part = c.part AND m.entry = c.entry
)"""
    return sql + near(ROUNDS) + f""", r AS (
  SELECT v.vec_id, v.label, string_agg(lower(printf('%02x', best.i)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM v JOIN n{ROUNDS} USING (uid) GROUP BY v.uid, v.vec_id, v.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256 FROM r
"""


ORACLE = _oracle()
