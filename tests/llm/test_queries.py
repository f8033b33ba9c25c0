"""The registered queries: names, SQL, plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry


def _name(n):
    return next(q for q in entry.queries() if re.match(rf"op{n}_", q))


def test_one_query_per_operator_and_the_pipeline():
    names = list(entry.queries())
    assert "pipeline" in names
    assert [sum(bool(re.match(rf"op{n}_", q)) for q in names) for n in range(1, 14)] == [1] * 13


def test_chat_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    res = con.execute(entry.oracle_sql()["op1_chat"])
    cols = [c[0] for c in res.description]
    want = sorted(tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in res.fetchall())
    df = entry.queries()["op1_chat"](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in sorted(cols)) for r in df.collect()) == want


@pytest.mark.parametrize("n", [1, 9])
def test_native_operators_have_no_python_in_their_plans(spark, sf_dir, n):
    plan = entry.queries()[_name(n)](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", range(1, 14))
def test_no_cross_join(spark, sf_dir, n):
    plan = entry.queries()[_name(n)](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_vector_queries_against_brute_force(spark, sf_dir):
    import numpy as np
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    out = {r.vec_id: r for r in entry.queries()[_name(5)](spark, sf_dir).collect()}
    assert all(out[i].n_links == n for i, n in zip(ids, (cos >= 0.95).sum(axis=1)))
    found = {}
    for r in entry.queries()[_name(4)](spark, sf_dir).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    asked = np.flatnonzero(ids % 50 == 0)
    hits = sum(len(set(ids[np.argsort(-cos[a])[:5]]) & set(found[ids[a]])) for a in asked)
    assert hits >= 0.9 * 5 * len(asked)
