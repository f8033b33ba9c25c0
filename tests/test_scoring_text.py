"""Pair scoring (M1–M4) and text preparation."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolink.operators import scoring as SC
from taxolink.operators import textprep as TX
from taxolink.session import written_plans


def test_head_matches_numpy(spark):
    d = 4
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, d)), rng.normal(size=(5, d))
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(5)], "i long, rvec array<double>, cvec array<double>")
    out = {r["i"]: r["p"] for r in SC.score_links(df, d).collect()}
    w1, b1, w2, b2 = SC.head_weights(d)
    for i in range(5):
        f = np.concatenate([np.abs(a[i] - b[i]), a[i] * b[i]])
        lg = np.tanh(f @ w1.T + b1) @ w2.T + b2
        p = 1 / (1 + math.exp(lg[0] - lg[1]))
        assert math.isclose(out[i], p, rel_tol=1e-9)
        assert 0.0 <= out[i] <= 1.0


def test_class_vectors_are_means(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0])], "label int, v array<double>")
    got = {r["class_idx"]: r["cvec"] for r in SC.class_vectors(df, "label", "v", 2).collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 5.0]}


def test_vocab_encode_pad_mask(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a b"), (3, None)], "doc_id long, text string")
    voc = {r["token"]: r["id"] for r in TX.build_vocab(docs).collect()}
    assert voc["<pad>"] == 0 and voc["<unk>"] == 1 and voc["<mask>"] == 2
    assert voc["b"] == 3 and voc["a"] == 4 and voc["c"] == 5
    enc = {r["doc_id"]: r["ids"] for r in TX.encode(docs, TX.build_vocab(docs)).collect()}
    assert enc[1] == [3, 4, 3, 5] and enc[2] == [4, 3]
    assert enc[3] == [1]                                    # null text reads as 'nan', an unknown word
    padded, mask = TX.pad(F.col("ids"), 5)
    out = TX.encode(docs, TX.build_vocab(docs)).select("doc_id", padded.alias("p"), mask.alias("m"))
    r = {x["doc_id"]: (x["p"], x["m"]) for x in out.collect()}
    assert r[2] == ([4, 3, 0, 0, 0], [1, 1, 0, 0, 0])


def test_mask_rate_and_targets(spark):
    ids = list(range(3, 4003))
    df = spark.createDataFrame([(7, ids)], "doc_id long, ids array<long>")
    masked, target = TX.mask_tokens(F.col("ids"), F.col("doc_id"), vocab_size=5000, rate=0.15, seed=42)
    r = df.select(masked.alias("m"), target.alias("t")).first()
    chosen = [i for i, t in enumerate(r["t"]) if t != TX.IGNORE]
    assert 0.12 < len(chosen) / len(ids) < 0.18
    assert all(r["t"][i] == ids[i] for i in chosen)
    assert all(r["m"][i] == ids[i] for i in range(len(ids)) if i not in set(chosen))
    n_mask = sum(1 for i in chosen if r["m"][i] == TX.MASK_ID)
    assert 0.7 < n_mask / len(chosen) < 0.9


def test_encode_reads_whole_texts_and_keeps_empty_ones(spark):
    docs = spark.createDataFrame([(1, "w " * 3000 + "last"), (2, "a b zz"), (3, ""), (4, "...")], "doc_id long, text string")
    voc = TX.build_vocab(docs.filter("doc_id <> 2"))
    ids = {r["token"]: r["id"] for r in voc.collect()}
    enc = {r["doc_id"]: r["ids"] for r in TX.encode(docs, voc).collect()}
    assert enc[1] == [ids["w"]] * 3000 + [ids["last"]]
    assert enc[2] == [TX.UNK_ID] * 3 and enc[3] == [] and enc[4] == []
    assert {r["doc_id"]: r["ids"] for r in TX.encode(docs, voc, max_len=2).collect()}[1] == [ids["w"]] * 2


def test_text_vectors_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, ""), (4, None)], "id long, text string")
    per = {}
    for r in SC.text_vectors(docs, ["id"]).collect():
        per.setdefault(r["id"], []).append(r["weight"])
    assert set(per) == {1, 2}
    assert all(math.isclose(sum(w * w for w in ws), 1.0) for ws in per.values())


@pytest.mark.parametrize("head, chars", [(65536, 64), (5, 64), (65536, 3), (0, 64)])
def test_words_outside_the_head_get_the_same_ids(spark, monkeypatch, head, chars):
    """Ids by rank whatever part of the vocabulary is sent out; repeated and null ids, unknown and repeated words."""
    monkeypatch.setattr(TX, "HEAD_WORDS", head)
    monkeypatch.setattr(TX, "HEAD_CHARS", chars)
    said = [(1, "a bb ccc dddd a"), (2, None), (3, ""), (None, "dddd nan bb"), (4, "ccc unseen ccc"), (4, "eeeee a"), (5, "--"),
            (6, "a " * 3000 + "eeeee")]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    voc = TX.build_vocab(docs.filter("text is null or not contains(text, 'unseen')").fillna("nan", ["text"])
                         .unionByName(spark.createDataFrame([(9, "ccc bb")], docs.schema)))
    ids = {r["token"]: r["id"] for r in voc.collect()}
    want = sorted((str(i), [ids.get(w, TX.UNK_ID) for w in ("nan" if t is None else t).replace("-", " ").split()]) for i, t in said)
    got = sorted((str(r.doc_id), r.ids) for r in TX.encode(docs, voc).collect())
    assert got == want


def test_text_vectors_deal_texts_and_look_the_frequent_words_up(spark, monkeypatch):
    """F6 of round 3: texts move once, not their words; the words outside the head give the same weights."""
    long_word = "x" * (TX.HEAD_CHARS + 1)
    texts = [(1, "a a b c d"), (1, "a e"), (None, "b f"), (None, "b"), (2, None), (3, ""), (4, f"{long_word} a c")] + [(9, "a b")] * 2
    docs = spark.createDataFrame(texts, "id long, text string")

    def found():
        return sorted((str(r.id), r.term_id, round(r.weight, 12)) for r in SC.text_vectors(docs, ["id"]).collect())

    with written_plans() as plans:
        whole = found()
    terms = dict(plans)["text-terms"]
    assert terms.index("Generate") < terms.index("Exchange") and "Exchange" not in terms[:terms.index("Generate")]
    counts = {}
    for i, t in texts:
        for w in (t or "").split():
            counts.setdefault(str(i), Counter())[w] += 1
    idf = {w: math.log(10 / (1 + sum(w in c for c in counts.values()))) for w in {w for c in counts.values() for w in c}}
    order = sorted(idf, key=lambda w: (-sum(c[w] for c in counts.values()), w))
    norm = {i: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) for i, c in counts.items()}
    assert whole == sorted((i, order.index(w) + 3, round(n * idf[w] / norm[i], 12)) for i, c in counts.items() for w, n in c.items())
    monkeypatch.setattr(SC, "HEAD_WORDS", 2)
    assert found() == whole


@pytest.mark.parametrize("head", [65536, 2, 0])
def test_text_vectors_among_are_those_of_whole_texts(spark, monkeypatch, head):
    """Only terms of the texts that meet the condition, weights and norms of the whole texts; null and repeated ids."""
    monkeypatch.setattr(SC, "HEAD_WORDS", head)
    texts = [("r", 1, "a a b c d"), ("r", 1, "a e"), ("r", None, "b f"), (None, 2, "b a x"), ("r", 3, None), ("r", 4, "zz a c"), ("r", 5, "q"),
             ("c", 1, "a c c"), ("c", None, "f g"), ("c", 7, "")]
    docs = spark.createDataFrame(texts, "kind string, id long, text string")
    whole = [tuple(r) for r in SC.text_vectors(docs, ["kind", "id"]).collect()]
    terms = {t for kind, _, t, _ in whole if kind == "c"}
    want = sorted((str(k), str(i), t, round(w, 12)) for k, i, t, w in whole if t in terms)
    got = SC.text_vectors(docs, ["kind", "id"], among=F.col("kind") == "c")
    assert got.columns == ["kind", "id", "term_id", "weight"]
    assert sorted((str(r.kind), str(r.id), r.term_id, round(r.weight, 12)) for r in got.collect()) == want
    assert 0 < len(want) < len(whole)
    assert SC.text_vectors(docs, ["kind", "id"], among=F.col("kind") == "none").collect() == []


def test_text_vectors_move_no_frequent_word(spark):
    """The bounded head of the vocabulary is sent out where the session broadcasts nothing by itself."""
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c")], "id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = SC.text_vectors(docs, ["id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [token" in plan and out.count() == 4
    finally:
        spark.conf.set(key, was)
