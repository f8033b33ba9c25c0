import math
import random

import numpy as np
from pyspark.sql import functions as F

from taxolink.llm import resampling


def _split(labels, part):
    return labels.filter(F.pmod(F.xxhash64(F.lit(part), "doc_id"), F.lit(2)) == 0), labels.filter(
        F.pmod(F.xxhash64(F.lit(part), "doc_id"), F.lit(2)) == 1)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    shown, held = _split(labels, 9)
    model, drawn = resampling.fit(docs, shown)
    kept = resampling.sampled_scores(drawn, model).select("doc_id", F.lit(1).alias("kept"))
    rates = {r.quality: r.rate for r in held.join(kept, "doc_id", "left").groupBy("quality")
             .agg(F.avg(F.coalesce("kept", F.lit(0))).alias("rate")).collect()}
    assert rates[1] >= 0.99 and rates[0] <= 0.02
    again = resampling.keep_sampled(docs, model)
    assert again.columns == docs.columns
    assert again.select("doc_id").exceptAll(kept.select("doc_id")).isEmpty()
    assert again.count() == kept.count()


def _plain_ngrams(text):
    import pyarrow as pa

    from taxolink.llm.words import text_chunks, word_spans
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    (_, _, buf, offsets), = text_chunks(batch)
    return resampling.ngrams(buf, *word_spans(buf, offsets))


def test_scores_match_a_count_by_count_computation(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("the a of Cat dog, SHOUT!! x1 é".split()) for _ in range(r.randint(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "word " * 3000), (103, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    good = {i for i, _ in docs if i % 3 == 0}
    flags = df.withColumn("good", (F.col("doc_id") % 3 == 0))
    table = resampling.count_ngrams(flags).collect()
    raw, target = np.zeros(resampling.FAMILIES * resampling.BUCKETS), np.zeros(resampling.FAMILIES * resampling.BUCKETS)
    for i, t in docs:
        for f in _plain_ngrams(t or "").ravel():
            raw[f] += 1
            target[f] += i in good
    for row in table:
        assert (raw[row.bucket], target[row.bucket]) == (row.raw, row.target)
    ratios = resampling.log_ratios(raw, target)
    got = {r.doc_id: r for r in resampling.score_documents(df, ratios).collect()}
    for i, t in docs:
        want = sum(ratios[f] for f in _plain_ngrams(t or "").ravel())
        assert math.isclose(got[i].log_ratio, want, abs_tol=1e-9)
    assert got[103].log_ratio == got[5].log_ratio


def test_draw_is_gumbel_top_k_and_repeats(spark):
    r = random.Random(3)
    good = [(i, " ".join(r.choice(["plain", "words", "of", "prose."]) for _ in range(20))) for i in range(80)]
    bad = [(i, " ".join(r.choice(["SPAM!!", "BUY!!", "NOW!!"]) for _ in range(20))) for i in range(80, 120)]
    rows = good + bad + [(500, None), (501, ""), (3, good[3][1]), (None, good[0][1])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 80, 2)] + [(i, 0) for i in range(80, 120, 2)]
                                   + [(7, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    model, drawn = resampling.fit(df, labels)
    table = drawn.collect()
    for x in table:
        if x.n_ngrams:
            noise = float(resampling.gumbel(np.array([x.doc_id or 0]), model.seed)[0])
            assert math.isclose(x.key, x.log_ratio - model.prior * x.n_ngrams + noise, abs_tol=1e-9)
    k = sum(x.n_ngrams > 0 and x.log_ratio >= model.prior * x.n_ngrams for x in table)
    keys = sorted((x.key for x in table if x.n_ngrams), reverse=True)
    assert model.cut == keys[k - 1]
    kept = sorted(map(tuple, resampling.keep_sampled(df, model).collect()), key=str)
    assert kept == sorted([x for x in ((*x, "c") for x in good + [(3, good[3][1]), (None, good[0][1])])], key=str)
    assert sorted(map(tuple, resampling.keep_sampled(df.repartition(5), model).collect()), key=str) == kept


def test_without_labels_of_both_kinds_all_stay(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        model, drawn = resampling.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert resampling.keep_sampled(df, model).count() == 2 == resampling.sampled_scores(drawn, model).count()
    model, drawn = resampling.fit(df.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert resampling.keep_sampled(df.limit(0), model).count() == 0


def test_kth_largest_with_ties(spark):
    r = random.Random(4)
    values = [r.choice([-5.0, 0.25, 1e-9, 3.0, 1e9]) for _ in range(300)] + [r.gauss(0, 1) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 150, 599, 600):
        assert resampling.kth_largest(df, k, bins=7) == ordered[k - 1]
    assert resampling.kth_largest(df, 601) == float("-inf")
    assert resampling.kth_largest(df.limit(0), 1) == float("-inf")
