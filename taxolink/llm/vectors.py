"""Helpers for tables of vectors: which rows take part, Arrow lists as matrices, spherical k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not empty, not zero, and hold no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0),
                      F.lit(False))


def common_width(rows: DataFrame, vector: str) -> int:
    """The most frequent length of a table's vectors (ties: the larger); 0 for an empty table."""
    best = (rows.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.desc("width")).first())
    return best["width"] if best else 0


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column without nulls as a float64 matrix."""
    if not len(col):
        return np.zeros((0, width))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (extreme magnitudes first brought near one)."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; a pair's value does not depend on its neighbours in a batch."""
    return (np.einsum("ij,ij->i", a, b)
            / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))))


def sample(rows: DataFrame, vector: str, id_col: str, most: int, width: int) -> np.ndarray:
    """At most ``most`` vectors as a matrix: those whose ids have the smallest hashes."""
    some = rows.orderBy(F.xxhash64(F.lit(11), id_col), id_col).limit(most).select(vector).toArrow()
    col = some.column(0).combine_chunks()
    return matrix(col.chunk(0) if isinstance(col, pa.ChunkedArray) else col, width)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centers of unit rows ``x``; fewer than ``k`` if there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[i:i + 8192] @ centers.T, axis=1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centers = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centers)
    return np.unique(centers, axis=0)
