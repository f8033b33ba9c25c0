import random

import pytest
from brute import similar

from taxolink.llm import set_join, sides
from taxolink.llm.components import connected_components


def _docs(seed, families=6, size=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            docs.append(" ".join(t))
    for _ in range(30):  # a passage that many documents share
        docs.append(" ".join(passage + [r.choice(words) for _ in range(r.randint(1, 60))]))
    docs += [None, "", "  \n", "one", "one", "ONE", "two words", "Two  words", "a b c", "x" * 5000, "a b c\x1cd"]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,n,num", [(1, 3, 90), (2, 5, 80), (3, 2, 50)])
def test_matches_brute_force(spark, monkeypatch, seed, n, num):
    monkeypatch.setattr(set_join, "GROUP", 4)   # many groups,
    monkeypatch.setattr(set_join, "HOT", 3)     # hot tokens and hard classes,
    monkeypatch.setattr(set_join, "BLOCK_SHINGLES", 500)  # and several blocks
    docs = _docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links)
           for r in set_join.similar_documents(df, n, num, 100).collect()}
    assert got == similar(docs, n, num, 100)


def test_links_beyond_all_size_bounds(spark, monkeypatch):
    monkeypatch.setattr(set_join, "FILTER_BITS", 1 << 15)   # a bitmap that is full of other tokens
    monkeypatch.setattr(sides, "BROADCAST_ROWS", -1)     # every join of texts by shuffle
    docs = _docs(5, families=20)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links)
           for r in set_join.similar_documents(df, 4, 70, 100).collect()}
    assert got == similar(docs, 4, 70, 100)


def test_production_parameters_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links)
           for r in set_join.similar_documents(df, 3, 90, 100).collect()}
    assert got == similar(docs, 3, 90, 100)


def test_many_exact_copies_are_one_class(spark):
    docs = [(i, "the same words again and again here") for i in range(500)] + [(900, "something else entirely, yes")]
    out = {r.doc_id: r for r in set_join.similar_documents(
        spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100).collect()}
    assert {out[i].component_id for i in range(500)} == {0} and out[7].n_links == 499
    assert (out[900].component_id, out[900].n_links) == (900, 0)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(set_join.similar_documents(df, 3, 90, 100).collect(), key=str)
    assert [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out] == [
        (4, 4, 4, 1), (4, 4, 4, 1), (9, 0, 9, 0), (None, 4, None, 0)]
    assert set_join.similar_documents(df.limit(0), 3, 90, 100).count() == 0


def test_one_of_each_keeps_columns_and_one_row_per_group(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (2, "a b c d e f g", "y"), (3, "other words are here now", "z"),
            (3, "other words are here now", "z"), (None, "q", "n"), (5, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    out = set_join.one_of_each(df, n=3, num=90, den=100)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a b c d e f g", "x"), (3, "other words are here now", "z"), (None, "q", "n"), (5, None, "e")], key=str)


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    out = connected_components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()
    roots = {r.node: r.root for r in out}
    assert len(roots) == 250
    assert len({roots[i] for i in range(1, 201)}) == 1 and len({roots[i] for i in range(1000, 1050)}) == 1
    assert roots[1] != roots[1000]
