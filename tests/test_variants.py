"""Outputs written as one unit, and dataset variants as one bundle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import rows
from taxolink.operators import variants as V
from taxolink.sources import bundle as BD


class Killed(Exception):
    pass


def _unit(spark, root, source, built, broken=False, params=None, recompute=False):
    def build():
        built.append(1)
        src = spark.read.parquet(source)
        bad = F.raise_error(F.lit("killed")).cast("long") if broken else F.col("id")
        return {"all": src, "even": src.filter("id % 2 = 0").select(bad.alias("id"))}
    return BD.materialize_unit(spark, root, build, [source], params, recompute)


def test_unit_is_built_once_and_again_for_other_inputs(spark, tmp_path):
    source, root, built = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(6).write.parquet(source)
    for _ in range(2):
        out = _unit(spark, root, source, built)
        assert rows(out["all"]) == [(i,) for i in range(6)] and rows(out["even"]) == [(0,), (2,), (4,)]
    assert len(built) == 1
    _unit(spark, root, source, built, params={"seed": 2})
    assert len(built) == 2
    _unit(spark, root, source, built, params={"seed": 2})
    assert len(built) == 2
    spark.range(6, 8).write.mode("append").parquet(source)
    out = _unit(spark, root, source, built, params={"seed": 2})
    assert len(built) == 3 and rows(out["even"]) == [(0,), (2,), (4,), (6,)]
    _unit(spark, root, source, built, params={"seed": 2}, recompute=True)
    assert len(built) == 4


def test_unit_with_a_missing_or_unfinished_part_is_built_again(spark, tmp_path):
    source, root, built = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(4).write.parquet(source)
    _unit(spark, root, source, built)
    (version,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("build-")]
    (version / "even" / "_SUCCESS").unlink()
    out = _unit(spark, root, source, built)
    assert len(built) == 2 and rows(out["even"]) == [(0,), (2,)]
    _unit(spark, root, source, built)
    assert len(built) == 2


def test_a_killed_build_is_never_read(spark, tmp_path):
    source, root, built = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(4).write.parquet(source)
    with pytest.raises(Exception, match="killed"):
        _unit(spark, root, source, built, broken=True)
    assert not (tmp_path / "out" / "manifest").exists()
    _unit(spark, root, source, built)
    spark.range(4, 6).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="killed"):
        _unit(spark, root, source, built, broken=True)  # the older manifest row has the older fingerprint
    out = _unit(spark, root, source, built)
    assert len(built) == 4 and rows(out["even"]) == [(0,), (2,), (4,)]


def test_fingerprint_tells_tables_apart_and_takes_an_empty_one(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(a)
    spark.range(0).write.parquet(b)
    one = BD.fingerprint(spark, [a, b])
    assert one == BD.fingerprint(spark, [b, a]) != BD.fingerprint(spark, [a]) != BD.fingerprint(spark, [b])


@pytest.mark.parametrize("variant", ["temporal", "random"])
def test_variant_bundle_parts(spark, variant):
    at = dt.datetime
    records = spark.createDataFrame(
        [(i, at(2001 + i % 3, 5, 1), f"r{i}") for i in range(12)] + [(50, None, "no date"), (60, at(2002, 5, 1), "no label")],
        "row_id long, ts timestamp, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(50, 0)], "row_id long, class_idx int")
    classes = spark.createDataFrame([("A", 0), ("B", 1)], "class_name string, class_idx int")
    crow = spark.createDataFrame([(0, "text of A"), (1, "text of B")], "row_id long, text string")
    parents = spark.createDataFrame([(0, [-1]), (1, [0]), (2, [0, 1])], "node long, parents array<long>")
    windows = {"train": (2001, 2001), "val": (2002, 2002), "test": (2003, 2003)}
    out = V.variant_bundle(variant, records, labels, classes, crow, parents, windows)
    assert set(out) == {"rows", "labels", "classes", "edges", "edges_indexed", "node_index", "depths", "levels", "ancestors"}
    got = {(r.row_kind, r.row_id): r for r in out["rows"].collect()}
    assert len(got) == 16
    masks = {k: (r.is_train, r.is_val, r.is_test) for k, r in got.items()}
    assert all(masks["class", c] == (False,) * 3 and got["class", c].is_class for c in (0, 1))
    assert masks["record", 50] == masks["record", 60] == (False,) * 3
    if variant == "temporal":
        assert all(masks["record", i] == tuple(i % 3 == k for k in range(3)) for i in range(12))
    else:
        assert all(sum(masks["record", i]) == 1 for i in range(12))
        assert sum(m[0] for m in masks.values()) == 8  # 0.7 of six rows of each class, rounded down
    assert rows(out["labels"].filter("row_kind = 'class'"), "row_id", "class_idx") == [(0, 0), (1, 1)]
    assert out["labels"].filter("row_kind = 'record'").count() == 13
    assert rows(out["ancestors"]) == [(1, 0), (2, 0), (2, 1)]
    assert rows(out["levels"], "node", "depth") == [(0, 0), (1, 1), (2, 1), (2, 2)]
    assert rows(out["node_index"]) == [(0, 0), (1, 1), (2, 2)]
