"""Column helpers: goldens G6–G10, G12 and the F-items of SURVEY §2.3."""

import datetime as dt

from pyspark.sql import functions as F

from taxolink.functions import (argmax2, concat_with_nan, cyclic_repeat, first_int, floor_frac,
                                order_key, parse_list_text, parse_zoned_ts, relation_ids,
                                threshold, truncate_text)
from taxolink.operators.splits import year_window


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_relation_ids_g6(spark):
    txt = "::NATURE:ChildOf:CWE ID:74:VIEW ID:1000::NATURE:ChildOf:CWE ID:943:VIEW ID:1000::"
    assert one(spark, relation_ids(F.lit(txt))) == [74, 943]
    dup = ("::NATURE:ChildOf:CWE ID:74:VIEW ID:1000::NATURE:ChildOf:CWE ID:20:VIEW ID:1003"
           "::NATURE:ChildOf:CWE ID:74:VIEW ID:1003::")
    assert one(spark, relation_ids(F.lit(dup))) == [74, 20]
    assert one(spark, relation_ids(F.lit("no relation"))) == [-1]
    assert one(spark, relation_ids(F.lit(None).cast("string"))) == [-1]


def test_parse_list_text_g7(spark):
    assert one(spark, parse_list_text(F.lit("['CWE-79', 'CWE-89']"))) == ["CWE-79", "CWE-89"]
    assert one(spark, parse_list_text(F.lit("CWE-79"))) == ["CWE-79"]
    assert one(spark, parse_list_text(F.lit("['NONE']"))) == ["NONE"]
    assert one(spark, parse_list_text(F.lit("[]"))) == []


def test_first_int(spark):
    assert one(spark, first_int(F.lit("CWE-79"))) == 79
    assert one(spark, first_int(F.lit("Brand#12"))) == 12
    assert one(spark, first_int(F.lit("none"))) is None


def test_class_text_nan_g12(spark):
    v = one(spark, concat_with_nan(F.lit("CWE-20"), F.lit(None).cast("string"), F.lit("x")))
    assert v == "CWE-20 nan x"


def test_truncate_text(spark):
    assert one(spark, truncate_text(F.lit(None).cast("string"))) == "nan"
    assert len(one(spark, truncate_text(F.lit("é" * 600)))) == 512


def test_cyclic_repeat_g10(spark):
    assert one(spark, cyclic_repeat(F.array(F.lit(2), F.lit(5)), 5)) == [2, 5, 2, 5, 2]
    assert one(spark, cyclic_repeat(F.array(F.lit(7)), 3)) == [7, 7, 7]
    assert one(spark, cyclic_repeat(F.array().cast("array<int>"), 3)) is None


def test_floor_frac_double_g9(spark):
    assert one(spark, floor_frac(F.lit(90), 0.7)) == 62
    assert one(spark, floor_frac(F.lit(90), 0.1)) == 9


def test_argmax_tie_and_threshold(spark):
    assert one(spark, argmax2(F.lit(0.5), F.lit(0.5))) == 0
    assert one(spark, argmax2(F.lit(0.4), F.lit(0.6))) == 1
    assert one(spark, threshold(F.lit(0.5), 0.5)) == 1
    assert one(spark, threshold(F.lit(0.49), 0.5)) == 0


def test_year_window_g8(spark):
    lo, hi = year_window(1990, 2020)
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r["lo"] == dt.datetime(1990, 1, 1, 5, 0)
    assert r["hi"] == dt.datetime(2020, 12, 31, 5, 0)
    _, hi21 = year_window(2021, 2021)
    assert one(spark, hi21) == dt.datetime(2022, 1, 1, 5, 0)


def test_parse_zoned_ts(spark):
    assert one(spark, parse_zoned_ts(F.lit("2021-01-05T15:15Z"))) == dt.datetime(2021, 1, 5, 15, 15)
    assert one(spark, parse_zoned_ts(F.lit("garbage"))) is None


def test_order_key_is_md5(spark):
    import hashlib
    assert one(spark, order_key(42, F.lit(1))) == hashlib.md5(b"42#1").hexdigest()
