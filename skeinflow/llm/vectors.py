"""Vectors as whole numbers, and exact products of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is one, without null, NaN and infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine


def limit(width: int, most: int = 1 << 62) -> int:
    """The largest component with which no sum of `width` products leaves `most`."""
    return math.isqrt(most // max(1, width))


def integers(lists: pa.Array, scale: int, width: int, largest: int) -> np.ndarray:
    """floor(scale * x) of the vectors of a column, as float64, a row for each; shorter ones end in zeros. Numbers
    beyond `largest` are held there."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    n = np.asarray(lists.value_lengths(), dtype=np.int64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(scale * flat), -largest, largest)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: as floats where these hold them, else as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T
