"""What the operators on vectors share: which vectors take part, and matrices from lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53


def sound(x: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype=np.float64) -> np.ndarray:
    """One row a list; missing components count as zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if len(flat) == len(column) * width and pc.all(pc.equal(pc.list_value_length(column), width)).as_py() is not False:
        return flat.reshape(len(column), width)
    sizes = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), width), dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list of each row of a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact, and held within 64 bits."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def add_groups(counts: np.ndarray, sums: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
    """Adds the rows of x, and how many they are, to the group that each belongs to."""
    if not len(own):
        return
    order = np.argsort(own, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
    at = own[order][heads]
    counts[at] += np.diff(np.r_[heads, len(own)])
    sums[at] += np.add.reduceat(x[order], heads, axis=0)
