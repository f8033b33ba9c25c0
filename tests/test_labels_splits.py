"""Labels, splits, sampling, batching: G1, G8, G9 and property checks."""

import datetime as dt

import hashlib
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from taxolink.operators import labels as L
from taxolink.operators import splits as SP
from taxolink.operators.ranking import exact_row_number
from taxolink.sources.fixtures import dummy_dataset

from helpers import rows


def test_dummy_masks_g1(spark):
    d = dummy_dataset(spark)["rows"]
    sizes = SP.split_sizes(d, SP.MASKS + ("is_class",)).first()
    assert d.count() == 17
    assert (sizes["n_train"], sizes["n_val"], sizes["n_test"], sizes["n_class"]) == (8, 13, 13, 4)


def test_class_index_drops_sentinels(spark):
    cat = spark.createDataFrame(
        [(n, i) for i, n in enumerate(["CWE-20", "CWE-74", "CWE-79", "CWE-89", "NVD-CWE-Other", "NVD-CWE-noinfo"])],
        "Name string, pos int")
    idx = L.class_index(cat, "Name", "pos", drop_names=("NVD-CWE-Other", "NVD-CWE-noinfo"))
    assert rows(idx, "class_name", "class_idx") == [("CWE-20", 0), ("CWE-74", 1), ("CWE-79", 2), ("CWE-89", 3)]


def test_encode_ignores_unknown_codes(spark):
    classes = spark.createDataFrame([("CWE-79", 0), ("CWE-89", 1)], "class_name string, class_idx int")
    codes = spark.createDataFrame([(1, "CWE-79"), (1, "CWE-89"), (2, "NVD-CWE-Other"), (3, "NONE")],
                                  "row_id long, code string")
    lab = L.encode_labels(codes, classes)
    assert rows(lab) == [(1, 0), (1, 1)]
    recs = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    assert rows(L.has_label(recs, lab, "row_id")) == [(1,)]


def test_temporal_split_bounds_g8(spark):
    ts = [dt.datetime(1990, 1, 1, 5, 0), dt.datetime(1990, 1, 1, 5, 1), dt.datetime(2020, 12, 31, 4, 59),
          dt.datetime(2020, 12, 31, 12, 0), dt.datetime(2021, 6, 1), dt.datetime(2022, 3, 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "row_id long, ts timestamp")
    out = SP.temporal_split(df, F.lit(True), "ts", {"train": (1990, 2020), "val": (2021, 2021), "test": (2022, 2022)})
    got = {r["row_id"]: (r["is_train"], r["is_val"], r["is_test"]) for r in out.collect()}
    assert got[0] == (False, False, False)      # on the open bound
    assert got[1] == (True, False, False)
    assert got[2] == (True, False, False)
    assert got[3] == (False, False, False)      # Dec 31 of a leap year falls out
    assert got[4] == (False, True, False)
    assert got[5] == (False, False, True)


def test_stratified_split_sizes_g9(spark):
    pool = spark.createDataFrame([(i, 0) for i in range(90)], "row_id long, class_idx int")
    s = SP.split_sizes(SP.stratified_split(pool)).first()
    assert (s["n_train"], s["n_val"], s["n_test"]) == (62, 9, 19)


def test_stratified_split_masks_may_overlap(spark):
    pool = spark.createDataFrame([(i, 0) for i in range(50)] + [(i, 1) for i in range(50)],
                                 "row_id long, class_idx int")
    out = SP.stratified_split(pool)
    assert out.count() == 50
    dealt = out.select((F.col("is_train").cast("int") + F.col("is_val").cast("int")
                        + F.col("is_test").cast("int")).alias("n"))
    assert {r["n"] for r in dealt.collect()} <= {1, 2}
    assert all(r["is_train"] or r["is_val"] or r["is_test"] for r in out.collect())


def test_exact_row_number_matches_window_under_skew(spark):
    data = [(0, i) for i in range(3000)] + [(g, i) for g in range(1, 30) for i in range(5)]
    df = spark.createDataFrame(data, "g int, k int").withColumn("o", F.md5(F.col("k").cast("string")))
    got = exact_row_number(df, ["g"], ["o", "k"], num_partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "k")))
    assert rows(got, "g", "k", "rn") == rows(ref, "g", "k", "rn")


def test_exact_row_number_global(spark):
    df = spark.range(1000).withColumn("o", F.md5(F.col("id").cast("string")))
    got = exact_row_number(df, [], ["o", "id"], num_partitions=5)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("o", "id")))
    assert rows(got, "id", "rn") == rows(ref, "id", "rn")


def test_class_cap_caps_raw_codes(spark):
    data = [(i, "A") for i in range(50)] + [(i, "B") for i in range(5)] + [(100 + i, "UNKNOWN-X") for i in range(20)]
    df = spark.createDataFrame(data, "row_id long, code string")
    kept = SP.class_cap(df, "row_id", "code", cap=10)
    ids = {r["row_id"] for r in kept.collect()}
    assert {0, 1, 2, 3, 4} <= ids                       # B is below the cap: all kept (they are in A too)
    assert len([i for i in ids if i >= 100]) == 10      # unknown codes form their own capped group
    a_kept = [i for i in ids if i < 50 and i >= 5]
    assert len(a_kept) <= 10


def test_batches(spark):
    df = spark.range(70).withColumnRenamed("id", "row_id")
    b = SP.batches(df, "row_id", 32, shuffle=False)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [6, 32, 32]
    first = {r["row_id"] for r in b.filter("batch_id = 0").collect()}
    assert first == set(range(32))
    sh = SP.batches(df, "row_id", 32, shuffle=True)
    assert sh.count() == 70 and sh.select("batch_id").distinct().count() == 3


def test_take_sample_is_reproducible(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a = [r["row_id"] for r in SP.take_sample(df, "row_id", 20).collect()]
    b = [r["row_id"] for r in SP.take_sample(df, "row_id", 20).collect()]
    assert a == b and len(set(a)) == 20


def test_reset_masks(spark):
    rowsdf = spark.createDataFrame([(1, True, True, True), (2, True, False, False)],
                                   "row_id long, is_train boolean, is_val boolean, is_test boolean")
    assigned = spark.createDataFrame([(2, False, True, False)],
                                     "row_id long, is_train boolean, is_val boolean, is_test boolean")
    out = SP.reset_masks(rowsdf, assigned, "row_id")
    assert rows(out, "row_id", "is_train", "is_val", "is_test") == [(1, False, False, False), (2, False, True, False)]


def test_dataset_variants(spark):
    recs = spark.createDataFrame([(i, dt.datetime(2019 + i % 3, 6, 1)) for i in range(30)], "row_id long, ts timestamp")
    lab = spark.createDataFrame([(i, i % 2) for i in range(30)], "row_id long, class_idx int")
    win = {"train": (2019, 2019), "val": (2020, 2020), "test": (2021, 2021)}
    t = SP.dataset_variant("temporal", recs, lab, windows=win)
    s = SP.split_sizes(t).first()
    assert (s["n_train"], s["n_val"], s["n_test"]) == (10, 10, 10)
    r = SP.dataset_variant("random", recs, lab, windows=win)
    s = SP.split_sizes(r).first()
    assert (s["n_train"], s["n_val"], s["n_test"]) == (20, 2, 8)


def test_class_cap_beyond_the_partial_limit_uses_exact_ranks(spark):
    df = spark.createDataFrame([(i, "A") for i in range(1500)] + [(i, "B") for i in range(1490, 1510)],
                               "row_id long, code string")
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    out = SP.class_cap(df, "row_id", "code", cap=1200)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\+- Window \[row_number", plan)   # no task sorts a whole group
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == before
    keys = sorted((hashlib.md5(f"42#A#{i}".encode()).hexdigest(), i) for i in range(1500))
    assert rows(out) == sorted((i,) for i in {i for _, i in keys[:1200]} | set(range(1490, 1510)))


def test_exact_row_number_random_groups(spark):
    import random
    random.seed(11)
    data = [(random.choice([0, 0, 0, 1, 2, 3]), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g int, k int")
    got = exact_row_number(df, ["g"], ["k"], num_partitions=13)
    per = {}
    for r in got.collect():
        per.setdefault(r["g"], []).append((r["k"], r["rn"]))
    for g, items in per.items():
        items.sort()
        assert [rn for _k, rn in items] == list(range(1, len(items) + 1))
