"""What the operators share: scratch tables in the cluster's shared folder, bounded Arrow
batches, and word hashing over whole byte buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python. Texts can be long, so batches are small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bytes of text that numpy works on at once; one longer text is still taken whole.
CHUNK_BYTES = 2 << 20
#: Bytes over which one running sum for hashes goes, so few that a core's cache holds it; one longer word is still
#: taken whole. No hash depends on it.
SUMMED = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in this session, so that Python workers' memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors and the driver see.

    Where the setting is absent and all runs in one process (tests), a temporary folder takes its
    place; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.morphlake.local.scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="morphlake")
        spark.conf.set("spark.morphlake.local.scratch", root)
    return f"{root.rstrip('/')}/morphlake-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost
    executor costs a task, not the whole plan."""
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def alone(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned in here go as soon as it ends: else they stay until the driver happens
    to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored_alone(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """stored(), without the shuffle files of the job that wrote it."""
    with alone(spark):
        return stored(spark, df, name)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where a column of df has one (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def in_bucket(column: str, modulus: int, remainder: int):
    """Whether crc32 of the value's text leaves this remainder. Null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# ---------------------------------------------------------------- hashing of words

U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, U(base & ((1 << 64) - 1)), U)
                steps[0] = U(1)
                _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offsets of each text. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return np.frombuffer(raw.tobytes().translate(_LOWER.tobytes()), np.uint8)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than ASCII white space, and how many
    words come before each text. No word crosses a text's end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = raw - np.uint8(9) > 4
    word &= raw != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(raw)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = word[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the range of words of each text.

    With lower, A-Z count as a-z; nothing else is folded.
    """
    raw, offsets = buffer_of(texts)
    if lower:
        raw = lowered(raw)
    starts, ends, splits = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), splits


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ordered spans of one buffer, from running sums over about SUMMED bytes, then mixed."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SUMMED, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        first, last = starts[i:j] - a, ends[i:j] - a
        up, down = _power_table(b - a + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(b - a + 1, U)
            np.cumsum(_BYTE[raw[a:b]] * up[: b - a], out=total[1:])
            out[i:j] = mix((total[last] - total[first]) * down[first] + (last - first).astype(U))
        i = j
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, rows: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most limit bytes of text each, or one row. With rows, a piece of fewer rows goes on
    to at most so many bytes."""
    if not batch.num_rows:
        return
    sizes = np.diff(buffer_of(batch.column(column))[1])
    start, used = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and used + size > limit and (used + size > most or min(i - start, len(sizes) - i) >= rows):
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += size
    yield batch.slice(start)


def shingle_hashes(words: np.ndarray, splits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words of each text (one of the whole, if it has fewer words,
    none if it has none), and the range of each text's hashes."""
    counts = np.diff(splits)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    with np.errstate(over="ignore"):
        full = np.zeros(len(words), U)
        if len(words) >= width:
            n = len(words) - width + 1
            run = np.zeros(n, U)
            for k in range(width):
                run += words[k : k + n] * U((_BASE * (2 * k + 3) | 1) & ((1 << 64) - 1))
            full[:n] = mix(run)
        kept = np.arange(out[-1]) - np.repeat(out[:-1], made) + np.repeat(splits[:-1], made)
        result = full[kept]
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            own = words[splits[i] : splits[i + 1]]
            factors = (np.arange(1, len(own) + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
            result[out[i]] = mix(np.array([(own * factors).sum() + U(len(own))], U))[0]
    return result, out
