import collections
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from taxolink.llm import spelling
from taxolink.llm.spelling import Codes, count_words, near_words, run_crcs, run_spans, spelling_variants, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(docs, least=6, times=5):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, pairs=None):
    """{word: (form, root, n, n_near, form_n)}; with many words, candidates share a word with one code point masked."""
    masks = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i] + "?" + w[i + 1:]].add(w)
            masks[w[:i] + w[i + 1:]].add(w)
        masks[w].add(w)
    beside = collections.defaultdict(set)
    for group in masks.values():
        for a in group:
            beside[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(beside[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(beside[w]), counts[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(counted(docs))
    assert got(entry.queries()["op12_spelling"](spark, sf_dir)) == want
    assert any(v[0] for v in want.values()) and any(v[3] for v in want.values())


def test_odd_texts_and_faults(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["Reading", "réading", "straße×÷", "cafÉs–xx", "ab12cdefghi", "İstanbul", "中abcdefg"])
                    for _ in range(3000))
    docs = [(i, text) for i in range(40)] + [(None, text), (None, None), (7, ""), (7, text), (8, "x" * 70 + " " + "y" * 5000),
                                            (9, "x" * 70 + " " + "y" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'a' AS word", "2 AS own")
    assert {r.word: r.n for r in count_words(df, least_count=1).collect()} == counted(docs, times=1)
    assert {r.word: r.n for r in count_words(df, least_chars=1).collect()} == counted(docs, least=1)
    assert got(spelling_variants(df)) == brute(counted(docs))
    for some in ([], [(1, None)], [(1, "12 34 a b")]):
        assert got(spelling_variants(spark.createDataFrame(some, "doc_id long, text string"))) == {}


@pytest.mark.parametrize("letters,symbols", [("abc", None), ("abcdefgh", (2,)), ("abcdefghijklmnopqrstuvwxyzàÿß", (3, 5))])
def test_pairs_whatever_the_alphabet(spark, monkeypatch, letters, symbols):
    if symbols:
        monkeypatch.setattr(spelling, "SYMBOLS", symbols)
        monkeypatch.setattr(spelling, "ALIKE", 0)  # the first that is smaller than the alphabet, however many words it maps together
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 8))) for _ in range(150)}
    for w in list(words):
        i = rng.randrange(len(w))
        words |= {w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w + rng.choice(letters)}
    words |= {w * 40 for w in list(words)[:5]} | {w * 40 + "a" for w in list(words)[:5]}
    counts = {w: 5 * rng.choice([1, 1, 5, 5, 25, 25, 125]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert got(variants(df)) == want
    pairs = [(r.word, r.other) for r in near_words(df).collect()]
    assert len(pairs) == len(set(pairs)) == sum(v[3] for v in want.values())


def test_long_chains_of_forms(spark):
    word, counts = "abcdefghij", {}
    for i in range(12):
        counts[word + "k" * i] = 5 ** (i + 1)
    assert got(variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)
    assert brute(counts)[word][1] == word + "k" * 11


def test_ties_take_the_smallest_word(spark):
    counts = {"abcdef": 5, "abcdex": 100, "abcdez": 100, "abcdeé": 100, "zbcdef": 24}
    assert got(variants(spark.createDataFrame(list(counts.items()), "word string, n long")))["abcdef"] == (
        "abcdex", "abcdex", 5, 4, 100)


def test_neighbours_are_all_words_one_edit_away_once():
    rng = random.Random(0)
    words = ["".join(chr(0x100 + rng.randrange(4)) for _ in range(rng.randint(1, 9))) for _ in range(50)]
    codes = Codes(words)
    found = collections.defaultdict(list)
    for word, key in codes.neighbours(4):
        for w, k in zip(word.tolist(), key.tolist()):
            found[w].append(k)
    for i, w in enumerate(words):
        every = {w[:p] + w[p + 1:] for p in range(len(w))}
        for s in map(chr, range(0x100, 0x104)):
            every |= {w[:p] + s + w[p + 1:] for p in range(len(w))} | {w[:p] + s + w[p:] for p in range(len(w) + 1)}
        every.discard(w)
        assert len(found[i]) == len(every) and set(found[i]) == set(Codes(sorted(every)).own().tolist())


def test_spans_and_checksums():
    texts = ["Abé c×", "", "ĀÀ", "x" * 200 + "-Zz", "中"]
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, ends = run_spans(buf, offsets)
    assert [buf[s:e].tobytes().decode() for s, e in zip(starts, ends)] == [w for t in texts for w in RUN.findall(t)]
    seeds = np.full(len(starts), zlib.crc32(b"12:"), np.uint32)
    assert run_crcs(buf, starts, ends, seeds).tolist() == [
        zlib.crc32(("12:" + w.translate(LOWER)).encode()) for t in texts for w in RUN.findall(t)]
