"""Vectors in Arrow batches, and which rows take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def usable(v: str) -> Column:
    """True for vectors that are not null, not zero, and hold no null or non-finite component."""
    c = F.col(v)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows as doubles; a shorter vector counts as padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hash_sample(rows: DataFrame, v: str, n: int, most: int, dim: int, distinct: bool = False) -> np.ndarray:
    """At most ``most`` of the ``n`` rows (``distinct``: of the ``n`` different vectors) by hash of the vector, in hash
    order (expected: ``most``, or all)."""
    h = F.xxhash64(v)
    share = 1e6 * min(1.0, 1.5 * most / max(n, 1))
    got = rows.select(F.col(v).alias("v"), h.alias("h")).where(F.expr(f"pmod(h, 1000000) < {share}"))
    got = (got.distinct() if distinct else got).orderBy("h", "v").limit(most).toArrow()
    return matrix(got["v"], dim)


def kmeans(x: np.ndarray, k: int, passes: int = 12) -> np.ndarray:
    """Spherical k-means on the rows of ``x`` (unit length): unit centroids, fixed seed."""
    rng = np.random.default_rng(3)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(passes):
        s = x @ c.T
        at = s.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=k) == 0)
        if len(empty):  # the rows that fit worst start new cells
            sums[empty] = x[np.argsort(s.max(axis=1))[: len(empty)]]
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c
