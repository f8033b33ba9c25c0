"""Embedding whitening by spectrum slicing: leading components of the covariance, certified by inertia counts.

Every entry c of a vector becomes the integer ``x = floor(64 * c) + 1000000``. The fit list is each distinct x vector
once (``n`` of them, per-dimension sums ``S``). ``t = n * x - S`` is exact in integers, and ``t / n`` is the centred
vector; it is centred before anything is multiplied. Partial sums come from one task each and are added up by Spark; only
sums (one per dimension or pair of dimensions) reach the driver.

The covariance's eigenvalues are sliced there. An LDL^T factorisation of ``V - s I`` (Bunch-Kaufman pivots) has as many
positive pivots as V has eigenvalues above s. Bisection on these counts isolates each leading eigenvalue; inverse iteration
and then Rayleigh quotient iteration, which converges cubically, give the eigenpair; counts on both sides of the
result certify its number. Eigenvalues that no shift separates (equal to rounding) are taken as one cluster: a basis of
its space is found by inverse iteration with orthogonalisation and turned by Rayleigh-Ritz. The sign of a component makes
its entry of largest size (ties: the first) positive.

Defined results: rows whose vector is null or empty, holds null or non-finite entries, or has another length than most are
dropped. Zero vectors, repeated rows and rows with a null id stay. Entries beyond 2**56 count as 2**56 with their
sign, so that x is a long. Components whose eigenvalue is zero to rounding (less than ``dimensions * 2**-44`` of the largest)
cannot be whitened and are left out: one distinct vector gives no rows, and so does an empty table. ``deviation`` is null beyond 38 digits.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolink.llm.vectors import common_width
from taxolink.llm.words import enter
from taxolink.session import write_and_read

SCALE, SHIFT, LARGEST = 64, 1000000, float(1 << 56)
#: Rows handled at a time inside a task.
STRIP = 2048
_KAUFMAN = (1 + 17 ** 0.5) / 8


def finite(vector: Column) -> Column:
    """True for vectors that are not null or empty and hold no null or non-finite entry."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def quantised(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of every entry, as longs."""
    def one(c: Column) -> Column:
        c = F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(c * SCALE) + F.lit(SHIFT).cast("long")
    return F.transform(vector, one)


# ------------------------------------------------------------------ spectrum slicing


def inertia(a: np.ndarray) -> tuple[int, int]:
    """Numbers of positive and negative pivots of the LDL^T factorisation of a symmetric matrix (Bunch-Kaufman)."""
    a = np.array(a, dtype=np.float64)
    n, k, plus, minus = len(a), 0, 0, 0
    while k < n:
        two = False
        if k < n - 1:
            column = np.abs(a[k + 1:, k])
            r = k + 1 + int(np.argmax(column))
            most = column[r - k - 1]
            if abs(a[k, k]) < _KAUFMAN * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0.0
                beside = row.max()
                if abs(a[k, k]) * beside >= _KAUFMAN * most * most:
                    pass
                elif abs(a[r, r]) >= _KAUFMAN * beside:
                    _swap(a, k, r)
                else:
                    _swap(a, k + 1, r)
                    two = True
        if two:
            block = a[k:k + 2, k:k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            if det < 0:
                plus, minus = plus + 1, minus + 1
            elif block[0, 0] + block[1, 1] > 0:
                plus += 2
            else:
                minus += 2
            rest = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot = a[k, k]
            plus, minus = plus + (pivot > 0), minus + (pivot < 0)
            if pivot != 0:
                rest = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(rest, rest / pivot)
            k += 1
    return plus, minus


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


class Slicer:
    """Leading eigenpairs of one symmetric matrix with counts of eigenvalues above shifts."""

    def __init__(self, matrix: np.ndarray):
        self.size = float(np.abs(matrix).max()) if len(matrix) else 0.0
        self.matrix = matrix / self.size if self.size > 0 else matrix  # entries near one, whatever their scale
        self.norm = float(np.linalg.norm(self.matrix, np.inf)) if len(matrix) else 0.0
        self.known: dict[float, int] = {}

    def above(self, shift: float) -> int:
        """How many eigenvalues lie above ``shift``."""
        if shift not in self.known:
            self.known[shift] = inertia(self.matrix - shift * np.eye(len(self.matrix)))[0]
        return self.known[shift]

    def isolate(self, number: int) -> tuple[float, float]:
        """An interval with eigenvalue ``number`` (from 1, falling), alone or with those no shift separates from it."""
        low, high = -1.5 * self.norm, 1.5 * self.norm
        for shift, count in self.known.items():  # what earlier counts tell
            if count >= number:
                low = max(low, shift)
            else:
                high = min(high, shift)
        while self.above(low) - self.above(high) > 1 and high - low > 64 * np.finfo(float).eps * self.norm:
            middle = (low + high) / 2
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    def solve(self, shift: float, right: np.ndarray) -> np.ndarray:
        """``(V - shift I)^-1 right``; a shift that hits an eigenvalue exactly is moved by a rounding unit."""
        eye = np.eye(len(self.matrix))
        for nudge in (0.0, 1.0, -2.0, 8.0):
            try:
                found = np.linalg.solve(self.matrix - (shift + nudge * np.finfo(float).eps * self.norm) * eye, right)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(found).all():
                return found
        raise ArithmeticError(f"no solution at shift {shift}")

    def pair(self, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """The only eigenvalue of its interval, and its unit vector."""
        low, high = self.isolate(number)
        rng = np.random.default_rng(number)
        for _ in range(60):
            value = (low + high) / 2
            v = _apart(rng.standard_normal(len(self.matrix)), found)
            for _ in range(2):  # inverse iteration from the middle of the interval
                v = _apart(self.solve(value, v), found)
            for _ in range(12):
                value = float(v @ self.matrix @ v)
                off = self.matrix @ v - value * v
                if not low <= value <= high:
                    break
                if np.linalg.norm(off) <= 4 * np.finfo(float).eps * self.norm:
                    break
                v = _apart(self.solve(value, v), found)
            value = float(v @ self.matrix @ v)
            if low <= value <= high and self.certify(number, value, v):
                return value, v
            middle = (low + high) / 2  # a neighbour drew the iteration away: a shorter interval
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        raise ArithmeticError(f"eigenvalue {number} was not found in [{low}, {high}]")

    def certify(self, number: int, value: float, v: np.ndarray) -> bool:
        """Counts on both sides of ``value``, a residual away, say that it is eigenvalue ``number``."""
        reach = np.linalg.norm(self.matrix @ v - value * v) + 64 * np.finfo(float).eps * self.norm
        return reach <= 1e-9 * self.norm and self.above(value - reach) >= number > self.above(value + reach)

    def cluster(self, low: float, high: float, found: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Eigenpairs of an interval whose eigenvalues no shift separates."""
        count = self.above(low) - self.above(high)
        rng = np.random.default_rng(count)
        basis: list[np.ndarray] = []
        while len(basis) < count:
            v = rng.standard_normal(len(self.matrix))
            for _ in range(4):
                v = _apart(self.solve((low + high) / 2, _apart(v, found + basis)), found + basis)
            basis.append(v)
        q = np.array(basis).T
        values, turn = np.linalg.eigh(q.T @ self.matrix @ q)
        return [(float(values[i]), (q @ turn)[:, i]) for i in range(count)[::-1]]

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """``(eigenvalues, unit vectors as rows)``: at most ``most``, falling, above zero beyond rounding."""
        values: list[float] = []
        vectors: list[np.ndarray] = []
        if self.size > 0:
            first, _ = self.isolate(1)
            floor = max(first, 0.0) * len(self.matrix) * 2.0 ** -44
            rank = self.above(floor)
            while len(values) < min(most, rank):
                low, high = self.isolate(len(values) + 1)
                if self.above(low) - self.above(high) > 1:
                    pairs = self.cluster(low, high, vectors)
                else:
                    pairs = [self.pair(len(values) + 1, vectors)]
                values += [p[0] for p in pairs]
                vectors += [p[1] for p in pairs]
        values, vectors = values[:most], vectors[:most]
        if not values:
            return np.zeros(0), np.zeros((0, len(self.matrix)))
        rows = np.array(vectors)
        rows *= np.sign(rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)])[:, None]
        return np.array(values) * self.size, rows


def _apart(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``v`` without its part along unit vectors ``others``, scaled to length one."""
    v = v / np.linalg.norm(v)
    for _ in range(2):
        for u in others:
            v = v - (u @ v) * u
        v = v / np.linalg.norm(v)
    return v


# ------------------------------------------------------------------ sums over the fit list


def _rows(col: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as an integer matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), width)


def scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where they are wide enough, Python's beyond."""
    reach = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums), default=0)
    if reach < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(t: np.ndarray, n: int) -> np.ndarray:
    """``t / n`` as doubles."""
    return (t / n).astype(np.float64)


def squares(t: np.ndarray) -> list[int]:
    """Exact sum of squares of every row."""
    if t.dtype != object and len(t):
        reach = max(int(t.max()), -int(t.min()))
        if reach * reach * t.shape[1] < 1 << 63:
            return np.einsum("ij,ij->i", t, t).tolist()
        t = t.astype(object)
    return [int(sum(row * row)) for row in t]


def _dimension_sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("whitening")
        n, high, low = 0, [0] * width, [0] * width
        for batch in batches:
            x = _rows(batch.column(0), width)
            n += len(x)  # halves of the numbers: no sum of a batch leaves 64 bits
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist())]
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
             pa.array([Decimal((h << 32) + w) for h, w in zip(high, low)], pa.decimal128(38, 0))], names=["i", "n", "s"])
    return run


def _product_sums(width: int, n: int, sums: list[int], weights: np.ndarray | None):
    """Partial sums of products of the centred vectors, or of their projections on ``weights``, upper triangle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("whitening")
        size = width if weights is None else weights.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIP):
                y = centred(scaled_deviations(_rows(batch.column(0).slice(lo, STRIP), width), n, sums), n)
                if weights is not None:
                    y = y @ weights
                total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                         names=["i", "j", "s"])
    return run


def _covariance(fit: DataFrame, width: int, n: int, sums: list[int], weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) over the fit list; the driver gets one number per pair of dimensions."""
    size = width if weights is None else weights.shape[1]
    out = np.zeros((size, size))
    parts = fit.mapInArrow(_product_sums(width, n, sums, weights), "i int, j int, s double")
    found = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    i, j = (found.column(c).to_numpy() for c in ("i", "j"))
    out[i, j] = out[j, i] = found.column("s").to_numpy() / n
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``weights`` holds a column per component, scaled to unit variance."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    weights: np.ndarray
    identity_error: float


def fit(rows: DataFrame, components: int = 16) -> Whitening:
    """Fit on the distinct rows of column ``x`` (arrays of longs of one length)."""
    distinct = write_and_read(rows.select("x").distinct(), "whitening-fit")
    first = distinct.first()
    if first is None:
        return Whitening(0, 0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0)
    width = len(first["x"])
    parts = distinct.mapInArrow(_dimension_sums(width), "i int, n long, s decimal(38,0)")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").cast("string").alias("s")).orderBy("i").collect()
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    v = _covariance(distinct, width, n, sums)
    values, vectors = Slicer(v).leading(components)
    weights = (vectors / np.sqrt(values)[:, None]).T
    error = 0.0
    if len(values):
        error = float(np.abs(_covariance(distinct, width, n, sums, weights) - np.eye(len(values))).max())
    trace = float(np.trace(v))
    return Whitening(width, n, sums, values, values / trace if trace else values, weights, error)


def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id",
           vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """``(id, deviation decimal(38,0), whitened array<double>)`` of every row that takes part, and the fit."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.filter(finite(F.col("vector")))
    width = common_width(rows, "vector")
    rows = rows.filter(F.size("vector") == width).select("id", quantised(F.col("vector")).alias("x"))
    model = fit(rows, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("whitening")
        limit = 10 ** 38
        size = model.weights.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIP):
                part = batch.slice(lo, STRIP)
                t = scaled_deviations(_rows(part.column(1), model.width), model.n, model.sums)
                z = centred(t, model.n) @ model.weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * size), pa.array(z.ravel()))
                exact = pa.array([Decimal(s) if s < limit else None for s in squares(t)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), exact, lists], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, "id long, deviation decimal(38,0), whitened array<double>"), model


def component_rows(whitened: DataFrame, model: Whitening) -> DataFrame:
    """A row per input row and component (from 1): ``(id, component, n, deviation, whitened, explained, identity_error)``."""
    explained = F.array(*(F.lit(float(e)) for e in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    out = whitened.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                      "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
                      F.lit(model.identity_error).alias("identity_error"))
