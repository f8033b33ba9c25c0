import math
import random

import numpy as np
import pytest
from brute import Union, cosine, usable
from pyspark.sql import functions as F

from taxolink.llm import vector_dedup, vector_search

F32 = "vec_id long, embedding array<float>"


def _rows(seed, n=400, width=8):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if i > 20 and r.random() < 0.5:
            base = rows[r.randrange(len(rows))][1]
            v = [x + r.gauss(0, 0.12) for x in base] if r.random() < 0.8 else list(base)
        else:
            v = [r.gauss(0, 1) for _ in range(width)]
        rows.append((i, v))
    return rows


ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0, None] + [0.0] * 6), (9005, [float("nan")] + [1.0] * 7),
       (9006, [float("inf")] + [1.0] * 7), (9007, [1.0, 2.0]), (None, [1.0] * 8)]


def _as_float32(rows):
    import numpy as np
    return [(i, [float(x) for x in np.array(v, np.float32)]) for i, v in rows]


@pytest.mark.parametrize("cells", [1, 40])
def test_dedup_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", max(1, 400 // cells))
    monkeypatch.setattr(vector_dedup, "MIN_CELLS", 1)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "STRIP", 5)
    rows = _rows(4)
    df = spark.createDataFrame(rows + ODD, F32).withColumn("cell", F.lit("x"))
    out = {r.id: r for r in vector_dedup.near_duplicates(df).collect()}
    exact, group, links = _as_float32(rows), Union(), {}
    for a, va in exact:
        for b, vb in exact:
            if a != b and (va == vb or cosine(va, vb) >= 0.95):
                links[a] = links.get(a, 0) + 1
                group.join(a, b)
    assert len(out) == len(rows) + len(ODD)
    for i, _ in rows:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (links.get(i, 0), group.find(i), group.find(i) == i)
    for i, _ in ODD:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)


def test_dedup_hot_vector_repeated_rows_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(5, 305)] + [(5, [1.0, 2.0, 3.0]), (1, [3.0, -2.0, 0.0])]
    df = spark.createDataFrame(rows, F32)
    out = vector_dedup.near_duplicates(df).collect()
    assert len(out) == 302
    assert all((r.n_links, r.component_id) == ((300, 5) if r.id != 1 else (0, 1)) for r in out)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def _exact_search(rows, every, k):
    exact = [(i, v) for i, v in rows if i is not None and usable(v) and len(v) == 8]
    out = {}
    for q, vq in exact:
        if q % every == 0:
            near = sorted((-cosine(vq, v), i) for i, v in exact if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_search_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAF_ROWS", 16)
    monkeypatch.setattr(vector_search, "BLOCK", 8)
    rows = _rows(6, 600)
    df = spark.createDataFrame(rows + ODD, F32)
    got = {}
    for r in vector_search.nearest(df, F.col("vec_id") % 7 == 0, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    want = _exact_search(_as_float32(rows), 7, 5)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        scores = [got[q][k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True) and q not in {i for i, _ in got[q].values()}
        hits += len({i for i, _ in near} & {i for i, _ in got[q].values()})
    assert hits >= 0.9 * 5 * len(want)


def test_search_ties_go_to_smaller_ids_and_few_candidates(spark):
    rows = [(i, [1.0, 1.0]) for i in range(0, 40)]
    out = vector_search.nearest(spark.createDataFrame(rows, F32), F.col("vec_id") == 2, k=5).collect()
    assert [(r["rank"], r.id) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert all(math.isclose(r.score, 1.0) for r in out)
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], F32)
    assert [(r.query_id, r["rank"], r.id) for r in vector_search.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    one = spark.createDataFrame([(0, [1.0, 0.0])], F32)
    assert vector_search.nearest(one, F.col("vec_id") == 0).count() == 0
    assert vector_search.nearest(one.limit(0), F.col("vec_id") == 0).count() == 0


def test_pairs_at_the_threshold_are_decided_by_their_own_cosine(spark):
    """Vectors whose cosines lie within rounding of 0.95: links are those of the row-wise cosine, whatever the block."""
    from taxolink.llm.vectors import cosine as own
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        a = rng.normal(size=8).astype(np.float32)
        b = rng.normal(size=8)
        b -= (a @ b) / (a @ a) * a
        b = (0.95 * a / np.linalg.norm(a) + np.sqrt(1 - 0.95 ** 2) * b / np.linalg.norm(b)).astype(np.float32)
        rows += [a, b]
    x = np.array(rows, dtype=np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    i, j = np.triu_indices(len(x), 1)
    linked = own(x[i], x[j]) >= 0.95
    want = np.bincount(i[linked], minlength=len(x)) + np.bincount(j[linked], minlength=len(x))
    got = {r.id: r.n_links for r in vector_dedup.near_duplicates(df, 0.95).collect()}
    assert [got[k] for k in range(len(x))] == want.tolist()


def _supplied(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<float>")).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)


def test_registered_search_over_the_supplied_table(spark, monkeypatch):
    """Several leaves, most of them not compared; exact scores in order; at least 0.9 of the exact neighbours."""
    from taxolink.llm.queries import op4_vector_search
    from taxolink.llm.vectors import cosine as own
    sf_dir, trees = "/root/testdata/sf0.01", []
    fit = vector_search.calibrate
    monkeypatch.setattr(vector_search, "calibrate", lambda spark, tree, *a: trees.append(tree) or fit(spark, tree, *a))
    ids, x = _supplied(spark, sf_dir)
    got = {}
    for r in op4_vector_search(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert trees[0].n_leaves >= 8
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    at = {int(i): n for n, i in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        exact = own(np.repeat(x[[at[q]]], len(x), axis=0), x)
        near = sorted((-s, int(i)) for s, i in zip(exact, ids) if i != q)[:5]
        assert [rank for rank, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert [(-s, v) for _, v, s in sorted(found)] == sorted((-s, v) for _, v, s in found)
        assert all(abs(s - exact[at[v]]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {i for _, i in near})
    assert hits >= 0.9 * 5 * len(got)


def test_search_goes_on_until_its_leaves_hold_enough(spark, monkeypatch):
    """Leaves of one class each and a single visit wanted: all five neighbours come all the same."""
    monkeypatch.setattr(vector_search, "LEAF_ROWS", 1)
    monkeypatch.setattr(vector_search, "calibrate", lambda *a: 1)
    rows = _rows(8, 100)
    out = vector_search.nearest(spark.createDataFrame(rows, F32), F.col("vec_id") % 10 == 0, k=5).groupBy("query_id").count()
    assert {r["count"] for r in out.collect()} == {5}


def test_a_query_is_compared_with_its_leaves_only():
    """A block of two leaves, one query per leaf: no query meets the other leaf's rows, however near."""
    import pyarrow as pa
    table = pa.table({
        "id": pa.array([1, 2, 3, 10, 11], pa.int64()),
        "vector": pa.array([[1, 0], [0, 1], [1, 1], [1, 0], [1, 0]], pa.list_(pa.float32())),
        "ids": pa.array([[1], [2], [3], None, None], pa.list_(pa.int64())),
        "leaves": pa.array([[7], [4], [4], [4], [7, 9]], pa.list_(pa.int32()))})
    out = vector_search._compare(5, 2)((), table).to_pylist()
    assert [(r["query"], r["id"]) for r in out] == [(10, 3), (10, 2), (11, 1)]


def test_registered_dedup_over_the_supplied_table(spark, monkeypatch):
    """The whole supplied table in several cells, against all pairs."""
    from taxolink.llm.queries import op5_vector_dedup
    from taxolink.llm.vectors import cosine as own
    sf_dir, centers = "/root/testdata/sf0.1", []
    fit = vector_dedup.spherical_kmeans
    monkeypatch.setattr(vector_dedup, "spherical_kmeans", lambda *a: centers.append(fit(*a)) or centers[-1])
    ids, x = _supplied(spark, sf_dir)
    group, links = Union(), dict.fromkeys(ids.tolist(), 0)
    for n in range(len(x)):
        scores = own(np.repeat(x[[n]], len(x), axis=0), x)
        for m in np.flatnonzero(scores >= 0.95):
            if m != n:
                links[int(ids[n])] += 1
                group.join(int(ids[n]), int(ids[m]))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op5_vector_dedup(spark, sf_dir).collect()}
    assert len(centers[0]) >= 8
    assert got == {i: (n, group.find(i), group.find(i) == i) for i, n in links.items()}
