from fractions import Fraction
from math import floor

import numpy as np
import pytest

import __spark_entry__ as entry
from taxolink.llm.whitening import Slicer, component_rows, inertia, scaled_deviations, squares, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=16):
    """Exact sums with fractions, components by a dense solver: n, sums, eigenvalues, vectors, trace."""
    x = sorted({tuple(floor(64 * float(c)) + 1000000 for c in v) for v in vectors})
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return n, sums, e[::-1][:k], u[:, ::-1][:, :k], np.trace(v)


def rotated(spectrum, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(spectrum), len(spectrum))))
    v = q @ np.diag(np.array(spectrum, float)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("spectrum", [
    list(range(1, 41)), [5, 5, 5, 3, 3, 1, 1, 0], [1] * 24, [1 + i * 1e-12 for i in range(20)], [7.0], [1, 0],
    [1e8, 1e4, 1, 1e-2, 0, 0], [1e-30 * i for i in range(1, 9)], [1e30, 1e30, 1]])
def test_slicer_finds_the_leading_eigenpairs(spectrum):
    v = rotated(spectrum) if len(spectrum) > 1 else np.array([spectrum])
    values, vectors = Slicer(v).leading(16)
    want = np.sort(spectrum)[::-1][:16]
    want = want[want > want[0] * len(spectrum) * 2.0 ** -44]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-14 * want[0])
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors.T - vectors.T * values).max() <= 1e-12 * want[0]


@pytest.mark.parametrize("seed", range(5))
def test_inertia_counts_eigenvalues_of_indefinite_matrices(seed):
    a = np.random.default_rng(seed).standard_normal((30, 30))
    a = a + a.T
    a[np.diag_indices(30)] *= seed % 2  # zero diagonals need pivots of two
    e = np.linalg.eigvalsh(a)
    for shift in np.random.default_rng(seed).uniform(e[0], e[-1], 30):
        b = a - shift * np.eye(30)
        assert inertia(b) == ((e > shift).sum(), (e < shift).sum())
    assert inertia(a) == ((e > 0).sum(), (e < 0).sum())
    assert inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1)


def test_exact_integers_beyond_64_bits():
    x = np.array([[1 << 61, -(1 << 61)], [5, 7]], dtype=np.int64)
    t = scaled_deviations(x, 2, [(1 << 61) + 5, 7 - (1 << 61)])
    assert t.tolist() == [[(1 << 61) - 5, -(1 << 61) - 7], [5 - (1 << 61), 7 + (1 << 61)]]
    assert squares(t) == [sum(c * c for c in row) for row in t.tolist()]
    assert squares(np.array([[3, 4], [1 << 40, 1]])) == [25, (1 << 80) + 1]


def check(out, model, vectors):
    n, sums, e, u, trace = brute(vectors.values())
    assert model.n == n and model.sums == sums
    x = {i: [floor(64 * float(c)) + 1000000 for c in v] for i, v in vectors.items()}
    rows = {}
    for r in out.collect():
        rows.setdefault(r.id, {})[r.component] = r
    assert set(rows) == set(vectors)
    got = np.array([[rows[i][k + 1].whitened for k in range(len(e))] for i in vectors])
    y = np.array([[(n * a - s) / n for a, s in zip(x[i], sums)] for i in vectors])
    want = y @ u / np.sqrt(e)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
    for i, per in rows.items():
        for k, r in per.items():
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[i], sums))
            assert abs(r.explained - e[k - 1] / trace) <= 1e-10 * r.explained and r.identity_error < 1e-9


def test_against_brute_force_with_every_odd_row(spark):
    rng = np.random.default_rng(1)
    data = {i: rng.normal(0, 1 + np.arange(6), 6).astype(np.float32).tolist() for i in range(60)}
    data |= {100: [0.0] * 6, 101: data[3], 102: data[3]}
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5),
           (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*data.items(), *odd]], SCHEMA).withColumnRenamed("label", "n")
    out, model = whiten(df)
    check(component_rows(out, model), model, data)
    assert component_rows(out, model).count() == 6 * len(data)


def test_rank_nulls_and_empty_tables(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 2.0, 3.0], 0), (None, [4.0, 2.0, 3.0], 0)], SCHEMA)
    out, model = whiten(flat)
    rows = component_rows(out, model).collect()
    assert sorted(((r.id or 0), r.component) for r in rows) == [(0, 1), (1, 1), (2, 1)] and rows[0].explained == 1.0
    for some in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        out, model = whiten(spark.createDataFrame(some, SCHEMA))
        assert component_rows(out, model).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 3.0], 0)], SCHEMA)
    out, model = whiten(huge)
    rows = component_rows(out, model).collect()
    assert rows and all(np.isfinite(r.whitened) for r in rows)
    t = [3 * x - s for x, s in zip((-(1 << 62) + 1000000, 64 * 2 + 1000000), model.sums)]  # row 2
    exact = sum(c * c for c in t)
    assert {r.deviation for r in rows if r.id == 2} == {exact if exact < 10 ** 38 else None}


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in rows}
    n, sums, e, u, trace = brute(vectors.values())
    out = entry.queries()["op11_whitening"](spark, sf_dir).collect()
    assert len(out) == 16 * len(vectors) and {r.n for r in out} == {n}
    got = np.zeros((len(vectors), 16))
    place = {i: k for k, i in enumerate(vectors)}
    for r in out:
        got[place[r.vec_id], r.component - 1] = r.whitened
    y = np.array([[(n * (floor(64 * float(c)) + 1000000) - s) / n for c, s in zip(v, sums)] for v in vectors.values()])
    want = y @ u / np.sqrt(e)
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    assert {r.identity_error for r in out}.__len__() == 1 and out[0].identity_error < 1e-9
    assert all(abs(r.explained - e[r.component - 1] / trace) < 1e-10 for r in out)
    dev = {r.vec_id: r.deviation for r in out}
    assert all(dev[i] == sum((n * (floor(64 * float(c)) + 1000000) - s) ** 2 for c, s in zip(v, sums)) for i, v in vectors.items())
