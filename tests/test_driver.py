"""End to end: every driver query against its DuckDB oracle on the sf0.001 tables, plus plan checks."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from helpers import SMOKE_DIR
from taxolink.plans.oracle import all_oracles
from taxolink.plans.queries import all_queries
from taxolink.session import written_plans

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "None"
    if hasattr(v, "item"):
        v = v.item()
    return str(v)


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"split", "class_idx", "n_records"}
    assert df.count() > 0


def test_every_query_has_oracle_or_is_ml():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    s = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert s == _rows(cols, res.fetchall())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_plan_has_no_cartesian_or_row_udf(spark, name):
    """In the final plan and in those of all intermediate tables."""
    with written_plans() as hidden:
        df = E.queries()[name](spark, SMOKE_DIR)
    for plan in [df._jdf.queryExecution().executedPlan().toString(), *(p for _, p in hidden)]:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name,table,most", [
    ("macro_f1", "documents", 1), ("beam_topk", "embeddings", 6), ("evaluate_split", "embeddings", 6),
    ("text_vectors", "documents", 2)])
def test_sources_are_scanned_no_more_than_needed(spark, name, table, most):
    """Scans of a source over the final plan and all intermediate tables (the beam: centroids, its records, and the
    record vectors once per level)."""
    with written_plans() as hidden:
        df = E.queries()[name](spark, SMOKE_DIR)
    plans = [df._jdf.queryExecution().executedPlan().toString(), *(p for _, p in hidden)]
    assert sum(len(re.findall(rf"FileScan parquet .*{table}\.parquet", p)) for p in plans) <= most


def test_class_cap_uses_partial_group_limit(spark):
    df = E.queries()["class_cap"](spark, SMOKE_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_are_pruned(spark):
    df = E.queries()["labelled_only"](spark, SMOKE_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_class_side_is_broadcast(spark):
    df = E.queries()["label_table"](spark, SMOKE_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
