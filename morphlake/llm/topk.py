"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors are integers, floor(256 * component). Candidates and queries are dealt into blocks; a
task gets one block of each. In a block, every component has a list of (value, candidate) in
order of value. For a query, the list of a component is read from the end where the products
are largest, all lists in step. What has been read of a candidate gives its partial score; the
list's last value read and the value at its far end bound what is unread. Reading stops when no
candidate outside the best k can still reach them; the scores that are still open are then
resolved by reading the rest of the lists for the candidates left over. The best k of each
block are merged.

Defined cases: null vectors, and vectors with null or non-finite components, take no part;
missing components of shorter vectors count as zero; rows that repeat an id are each a
candidate, but a row never answers a query of its own id. Ties go to the smaller id. A null id
takes no part. Nothing is approximate: scores that doubles can't hold are summed as whole numbers, and
those beyond 64 bits rank by their value and are shown as the nearest number of 64 bits. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm.common import bounded_batches, table

K, SCALE = 5, 256
#: Rows of a block of candidates and of queries, at most about; the least number of candidate blocks.
CANDIDATES, QUERIES, LEAST_BLOCKS = 2048, 2048, 32
#: Shares of the lists after which bounds are compared.
DEPTHS = (0.25, 0.5, 0.75)
#: Queries that are scored at once; bounds the memory of a task to about 2048 * 256 * 8 bytes a table.
STEP = 256


def block_top_k(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of each query's best k candidates of another id in this block."""
    n, d = vectors.shape
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1) < 2.0**53
    kind = (lambda x: x.astype(np.float64)) if exact else np.frompyfunc(int, 1, 1)
    order = np.argsort(vectors, axis=0, kind="stable")  # ascending lists; read backwards they descend
    values = kind(np.take_along_axis(vectors, order, axis=0))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), STEP):
        q = queries[start : start + STEP]
        out.append(_aggregate(ids, order, values, query_ids[start : start + STEP], kind(q), k, start))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _aggregate(ids, order, values, query_ids, q, k, start):
    n, d = values.shape
    up, down = np.where(q > 0, q, 0).T, np.where(q < 0, q, 0).T  # [d, queries]
    partial = np.zeros((n, len(q)), q.dtype)
    seen_top, seen_bottom = np.zeros((n, d), bool), np.zeros((n, d), bool)
    own = ids[:, None] == query_ids[None, :]
    read = 0
    for share in (*DEPTHS, 1.0):
        depth = n if share == 1.0 else int(n * share)
        for j in range(d):  # each list is read on from where it stood, from both ends
            top, bottom = order[n - depth : n - read, j], order[read:depth, j]
            if up[j].any():
                partial[top] += values[n - depth : n - read, j][:, None] * up[j]
            if down[j].any():
                partial[bottom] += values[read:depth, j][:, None] * down[j]
            seen_top[top, j] = True
            seen_bottom[bottom, j] = True
        read = depth
        if depth in (0, n) or n <= k + 1:
            continue
        rest_top, rest_bottom = (~seen_top).astype(q.dtype), (~seen_bottom).astype(q.dtype)
        most = partial + rest_top @ (values[n - depth][:, None] * up) + rest_bottom @ (values[depth - 1][:, None] * down)
        least = partial + rest_top @ (values[0][:, None] * up) + rest_bottom @ (values[n - 1][:, None] * down)
        least = np.where(own, -np.inf, least) if q.dtype != object else np.where(own, -(10**300), least)
        bar = np.partition(least, n - k, axis=0)[n - k] if q.dtype != object else np.sort(least, axis=0)[n - k]
        alive = (most >= bar) & ~own
        if alive.any(axis=1).mean() <= 0.5 or alive.mean() <= 0.02:
            return _resolve(ids, order, values, up, down, partial, alive, read, k, start)
    return _best(ids, partial, ~own, k, start)


def _resolve(ids, order, values, up, down, partial, alive, read, k, start):
    """Reads on for the candidates that some query still needs."""
    n, d = values.shape
    needed = alive.any(axis=1)
    for j in range(d):
        top, bottom = order[: n - read, j], order[read:, j]
        top_in, bottom_in = needed[top], needed[bottom]
        partial[top[top_in]] += values[: n - read, j][top_in][:, None] * up[j]
        partial[bottom[bottom_in]] += values[read:, j][bottom_in][:, None] * down[j]
    return _best(ids, partial, alive, k, start)


def _best(ids, scores, allowed, k, start):
    """The best k of each query by score, then id."""
    rows, found, won = [], [], []
    for i in range(scores.shape[1]):
        at = np.flatnonzero(allowed[:, i])
        if not len(at):
            continue
        s = scores[at, i]
        if len(at) > 4 * k and scores.dtype != object:
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
            s = scores[at, i]
        s = s.astype(np.int64) if scores.dtype != object else s
        first = sorted(zip((-x for x in s.tolist()), ids[at].tolist(), strict=True))[:k]
        rows += [start + i] * len(first)
        won += [min(max(-a, -(2**63)), 2**63 - 1) for a, _ in first]
        found += [b for _, b in first]
    return np.array(rows, np.int64), np.array(found, np.int64), np.array(won, np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _block(candidates: pa.Table, queries: pa.Table) -> pa.Table:
    if not candidates.num_rows or not queries.num_rows:
        return RESULT.empty_table()
    width = max(pc.max(pc.list_value_length(x.column("__v"))).as_py() or 0 for x in (candidates, queries))
    ids, query_ids = (x.column("__id").to_numpy() for x in (candidates, queries))
    rows, found, won = block_top_k(ids, _matrix(candidates.column("__v"), width), query_ids, _matrix(queries.column("__v"), width))
    return pa.table([query_ids[rows] if len(rows) else rows, found, won], schema=RESULT)


def top_k(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates."""
    spark = candidates.sparkSession
    bounded_batches(spark)
    x = F.col("__raw")
    good = x.isNotNull() & F.col("__id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  larger doubles are whole
    scaled = F.transform(x, lambda v: whole(v.cast("double") * SCALE))
    prepare = lambda df: df.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("__raw")).filter(good).select("__id", scaled.alias("__v"))
    left, right = prepare(candidates), prepare(queries)
    blocks = max(LEAST_BLOCKS, -(-candidates.count() // CANDIDATES))
    query_blocks = max(1, -(-queries.count() // QUERIES))
    place = lambda n: F.pmod(F.xxhash64("__id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = left.select("*", place(blocks).alias("__cb")).select("*", every(query_blocks).alias("__qb"))
    right = right.select("*", place(query_blocks).alias("__qb")).select("*", every(blocks).alias("__cb"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    best = left.groupBy("__cb", "__qb").cogroup(right.groupBy("__cb", "__qb")).applyInArrow(_block, schema)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
