import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from taxolink.llm.sentence_pieces import WordIds, decode, digests, encode, encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "   ", "a", "  a ", "▁a", "a ▁ b", "x\ty\nz\r\n", "\xa0b", "日本語 \U0001F600", "a\0b", "ﬁ½ é",
       "</s> <s> <unk> <0x41>", "﻿hi", " " * 15, " " * 1000, " " * 31 + "x" + " " * 47, "a" * 50, "ab" * 77, "\n" * 100,
       "===" * 50, "aaa  bbb   ccc    ddd     e", "▁" * 33, "\U0001F600" * 40, "一" * 200]


@pytest.fixture(scope="module")
def words():
    return WordIds(PATH)


def same(words, texts):
    got = [ids.tolist() for ids in encoded(words, pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))]
    assert got == [words.table.library.encode(t or "", add_eos=True) for t in texts]


def test_odd_texts(words):
    same(words, ODD)


@pytest.mark.parametrize("letters,longest,count", [
    ("abcdefgh  ▁\n\té日\U0001F600ñ-=_.,0123", 60, 4000), ("ab", 60, 3000), ("etaoinshrdlu", 300, 500), ("-=*# ", 80, 2000),
    ("the and of in ", 40, 3000), ("éèüñ ", 50, 1000)])
def test_random_texts(words, letters, longest, count):
    rng = random.Random(longest)
    same(words, ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(count)])


def test_repeats_and_very_long_words(words):
    rng = random.Random(5)
    same(words, [rng.choice(["ab", "the", "-", " ", "\n", "10", "  x", "é"]) * rng.randint(1, 300) for _ in range(300)])
    same(words, [" " * 200000 + "end", "".join(rng.choice("etaoinshrdlu") for _ in range(5000)), "ab " * 100000])


def test_words_are_kept_and_let_go(words, monkeypatch):
    from taxolink.llm import sentence_pieces
    monkeypatch.setattr(sentence_pieces, "KEEP", 50)
    monkeypatch.setattr(sentence_pieces, "CHUNK_BYTES", 200)
    rng = random.Random(6)
    same(WordIds(PATH), [" ".join(str(rng.randrange(400)) for _ in range(30)) for _ in range(200)] + ODD)


def test_tables_round_trip(spark, words):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(ODD)] + [(None, "a b", "old")] * 2, "doc_id long, text string, ids string")
    ids = encode(df, PATH)
    assert ids.columns == ["doc_id", "ids"]
    library = words.table.library
    for r in ids.collect():
        assert r.ids == library.encode((ODD[r.doc_id] if r.doc_id is not None else "a b") or "", add_eos=True)
    back = {r.doc_id: r.text for r in decode(ids, PATH).collect()}
    assert all(back[i] == library.decode(library.encode(t or "")) for i, t in enumerate(ODD))
    assert ids.count() == len(ODD) + 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(none, PATH), PATH).collect() == [] and digests(none, PATH).collect() == []
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_query_against_the_library(spark, sf_dir, words):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.queries()["op13_sentence_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = words.table.library.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(words.table.library.decode(ids).encode()).hexdigest()
