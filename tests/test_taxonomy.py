"""Hierarchy operators: G2, G3 and the DAG fixtures (chain, mixed root, cycle, missing parent)."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as E
from taxolink.operators import taxonomy as H
from taxolink.session import written_plans
from taxolink.sources.fixtures import dummy_dataset

from helpers import SMOKE_DIR, rows


def parents_df(spark, mapping):
    return spark.createDataFrame([(n, p) for n, p in mapping.items()], "node long, parents array<long>")


def depth_map(paths):
    out = {}
    for r in H.depth_lists(paths).collect():
        out[r["node"]] = [d for d, n in r["depths"] for _ in range(int(n))]
    return out


@pytest.mark.parametrize("diamonds", [3, 30])
def test_a_ladder_of_diamonds_doubles_the_paths(spark, diamonds):
    tree = {0: [-1]}
    for i in range(diamonds):
        tree |= {3 * i + 1: [3 * i], 3 * i + 2: [3 * i], 3 * i + 3: [3 * i + 1, 3 * i + 2]}
    paths = H.depth_paths(parents_df(spark, tree))
    top = paths.filter(F.col("node") == 3 * diamonds).collect()
    assert [(r.depth, int(r.n_paths), r.mantissa, r.exponent) for r in top] == [(2 * diamonds, 2 ** diamonds, 0.5, diamonds + 1)]
    runs = {r.node: r.depths for r in H.depth_lists(paths).collect()}
    assert [tuple(x) for x in runs[3 * diamonds]] == [(2 * diamonds, 2 ** diamonds)]


def test_path_counts_beyond_38_digits_and_across_exponents(spark):
    width, rungs = 1000, 14  # 1000 ** 13 paths to the last rung
    tree = {i: [-1] for i in range(width)}
    for r in range(1, rungs):
        tree |= {r * width + i: [(r - 1) * width + j for j in range(width)] for i in range(1 if r == rungs - 1 else 20)}
        if r < rungs - 1:
            tree |= {r * width + i: [(r - 1) * width] for i in range(20, width)}
    want = {0: dict.fromkeys(range(width), 1)}
    for r in range(1, rungs):
        want[r] = {n - r * width: sum(want[r - 1][p - (r - 1) * width] for p in ps) for n, ps in tree.items() if n // width == r}
    got = H.depth_paths(parents_df(spark, tree)).filter(f"depth = {rungs - 1}").collect()
    assert len(got) == 1
    exact = want[rungs - 1][0]
    assert got[0].n_paths == (exact if exact < 10 ** 38 else None)
    assert abs(got[0].mantissa * 2.0 ** got[0].exponent / exact - 1) < 1e-12 and 0.5 <= got[0].mantissa < 1


def test_diamond_depths_g3(spark):
    p = parents_df(spark, {0: [1, 3], 1: [-1], 2: [-1], 3: [1, 2]})
    assert depth_map(H.depth_paths(p)) == {0: [1, 2, 2], 1: [0], 2: [0], 3: [1, 1]}
    inv = rows(H.parent_child_edges(p), "parent", "child")
    assert inv == [(-1, 1), (-1, 2), (1, 0), (1, 3), (2, 3), (3, 0)]


def test_dummy_hierarchy_g2(spark):
    d = dummy_dataset(spark)
    p = d["parents"]
    lv = rows(H.levels(H.depth_paths(p)), "depth", "node")
    assert lv == [(0, 1), (0, 2), (0, 3), (1, 0)]
    clo = H.ancestors(p)
    assert rows(clo) == [(0, 1)]
    rowmask = d["rows"].filter("is_train or is_val or is_test or is_class").select("row_id")
    exp = H.expand_labels(d["labels"], clo, rowmask)
    got = {}
    for r in exp.collect():
        got.setdefault(r["row_id"], set()).add(r["class_idx"])
    for rid in (0, 1, 4, 13):
        assert got[rid] == {0, 1}
    assert got[5] == {1}


def test_chain(spark):
    p = parents_df(spark, {1: [-1], 2: [1], 3: [2], 4: [3]})
    assert depth_map(H.depth_paths(p))[4] == [3]
    clo = H.ancestors(p)
    assert {r["ancestor"] for r in clo.filter("node = 4").collect()} == {1, 2, 3}
    # closure is transitive and excludes self on a DAG
    assert clo.filter(F.col("node") == F.col("ancestor")).count() == 0


def test_mixed_root(spark):
    p = parents_df(spark, {5: [-1, 6], 6: [-1]})
    assert depth_map(H.depth_paths(p)) == {5: [0], 6: [0]}
    assert H.ancestors(p).filter("node = 5").count() == 0
    assert (6, 5) in rows(H.parent_child_edges(p), "parent", "child")
    idx = spark.createDataFrame([(5, 0), (6, 1)], "node long, class_idx long")
    cp = rows(H.index_edges(p, idx).filter("form = 'child_parent' and src = 0"), "pos", "dst")
    assert cp == [(0, -1), (1, -1)]


def test_cycle_reported_and_ends(spark):
    p = parents_df(spark, {7: [8], 8: [7], 1: [-1]})
    probs = rows(H.problems(p), "node", "problem")
    assert (7, "cycle") in probs and (8, "cycle") in probs
    with pytest.raises(H.HierarchyError):
        H.ancestors(p)
    assert depth_map(H.depth_paths(p)) == {1: [0]}


def test_cycle_below_root_raises(spark):
    p = parents_df(spark, {1: [-1], 2: [1, 3], 3: [2]})
    with pytest.raises(H.HierarchyError):
        H.depth_paths(p, max_rounds=10)


def test_missing_parent(spark):
    p = parents_df(spark, {9: [77], 1: [-1]})
    assert rows(H.problems(p), "node", "problem") == [(9, "missing_parent")]


def test_catalog_b_hierarchy(spark):
    cat = spark.createDataFrame([
        (20, None),
        (74, "::NATURE:ChildOf:CWE ID:20:VIEW ID:1000::"),
        (79, "::NATURE:ChildOf:CWE ID:74:VIEW ID:1000::NATURE:ChildOf:CWE ID:20:VIEW ID:1003"
             "::NATURE:ChildOf:CWE ID:74:VIEW ID:1003::"),
        (89, "::NATURE:ChildOf:CWE ID:943:VIEW ID:1000::"),
        (999, None)], "id long, rel string")
    valid = spark.createDataFrame([(20,), (74,), (79,), (89,)], "node long")
    p = H.keep_valid(H.parse_parents(cat, "id", "rel"), valid)
    assert {r["node"]: r["parents"] for r in p.collect()} == {20: [-1], 74: [20], 79: [74, 20], 89: [-1]}
    assert depth_map(H.depth_paths(p)) == {20: [0], 74: [1], 79: [1, 2], 89: [0]}
    lv = rows(H.levels(H.depth_paths(p)), "depth", "node")
    assert lv == [(0, 20), (0, 89), (1, 74), (1, 79), (2, 79)]


def test_graph_listing(spark):
    p = parents_df(spark, {1: [-1], 2: [1], 5: [-1, 6]})
    names = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], "node long, name string")
    out = H.graph_listing(p, names)
    edges = rows(out.filter("kind = 'edge'"), "src", "dst")
    assert edges == [(1, 1003), (2, 1), (5, 1003)]
    labels = {r["label"] for r in out.filter("kind = 'node'").collect()}
    assert "CWE-ID 2:b" in labels and "CWE-ID 1003:Root Node" in labels


def test_expanded_rows_are_made_distinct_after_they_are_dealt_by_record(spark):
    """F4, F5 of round 3: no task keeps what its part of the input expands to before the shuffle."""
    lab = [(1, 4), (1, 4), (1, 5), (2, 3), (2, None), (None, 5), (None, 5), (3, 77)]
    clo = {4: (2, 1), 5: (2, 1), 3: (1,)}
    want = set(lab) | {(r, a) for r, c in lab for a in clo.get(c, ())}
    closure = spark.createDataFrame([(c, a) for c, up in clo.items() for a in up], "node long, ancestor long")
    out = H.expand_labels(spark.createDataFrame(lab, "row_id long, class_idx long"), closure)
    assert sorted(map(str, out.collect())) == sorted(str(Row(row_id=r, class_idx=c)) for r, c in want)
    for name in ("expand_labels", "expanded_links"):
        with written_plans() as hidden:
            plan = E.queries()[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "expanded" not in [n for n, _ in hidden]
        dealt = plan[plan.index("Exchange hashpartitioning(row_id"):].split("\n")
        assert "REPARTITION_BY_NUM" in dealt[0] and "Union" in dealt[1]
