import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taxolink.llm import packing, token_files
from taxolink.llm.tokens import PieceEncoder, encoded_rows

BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD_TEXTS = [None, "", " ", "  \n\n x", "a  b", "a  b    c　", "x<|endoftext|>y <|endoftext|> z",
             "it's  don't \t\n foo\r\n\r\nbar  ", "  lead", "trail   ", "é ́x", "ΑΣ ΣΑΣ", "123 4567 ½",
             "a\x1cb \x1d c", "a \u0085 b", "😀 👩‍👩‍👧 x", "ẞ İ İ", "​ a​ b", "ABC abc Abc", "z" * 9000]


def _plain(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORDS, False)])
def test_pieces_give_the_ids_of_whole_texts(path, spaced):
    texts = ODD_TEXTS + [a + b for a in ODD_TEXTS[1:14] for b in ODD_TEXTS[1:14]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    encoder = PieceEncoder(path, spaced)
    for _ in range(2):  # learnt, then known
        assert [x.tolist() for _, x in encoded_rows(encoder, batch, 1)] == [_plain(path, t, 1) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabAB'.,1é  é", max_size=40), max_size=6))
def test_pieces_on_random_texts(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for path, spaced in ((BYTE, True), (WORDS, False)):
        got = [x.tolist() for _, x in encoded_rows(PieceEncoder(path, spaced), batch, 0)]
        assert got == [_plain(path, t, 0) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(
    st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 12), max_size=12))))
def test_solver_packs_every_piece_once(case):
    capacity, counts = case
    patterns = packing.solve(counts, capacity)
    used = {}
    for times, inside in patterns:
        assert times > 0 and sum(x * n for x, n in inside) <= capacity
        for x, n in inside:
            used[x] = used.get(x, 0) + times * n
    assert used == counts
    total, least = sum(t for t, _ in patterns), -(-sum(x * n for x, n in counts.items()) // capacity)
    assert least <= total <= 1.7 * least + 1
    ranges = packing.pattern_ranges(patterns)
    for x in counts:
        spans = sorted((a, b) for y, a, b, *_ in ranges if y == x)
        assert spans[0][0] == 0 and spans[-1][1] == counts[x] and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))


def _optimum(pieces, capacity):
    best = [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= pieces[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, rest + [r - pieces[i]])
        place(i + 1, rooms + [capacity - pieces[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_keeps_an_optimum(pieces):
    counts = {x: pieces.count(x) for x in pieces}
    fixed, rest = packing.reduce_instance(counts, 20)
    left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(t for t, _ in fixed) + (_optimum(left, 20) if left else 0) == _optimum(sorted(pieces, reverse=True), 20)


def test_pack_rebuilds_all_documents(spark):
    texts = ODD_TEXTS + ["word " * 700, "word " * 700, "long text with many words " * 900]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, BYTE, capacity=512).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in docs:
        ids, at = _plain(BYTE, text, 0), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 512 or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_pack_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text", "x")] * 50, "doc_id long, text string, length string")
    rows = packing.pack(df, BYTE, capacity=9).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50


def test_token_files_round_trip(spark, tmp_path):
    docs = [(i * 3, t) for i, t in enumerate(ODD_TEXTS + ["some more words " * 40] * 30)] + [(None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    folder = f"file://{tmp_path}/set"
    manifest = token_files.write_token_files(df, WORDS, folder, partitions=3, file_docs=7)
    got = sorted(token_files.read_token_files(folder, manifest).collect(), key=lambda r: r.start)
    want = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    at = 0
    for r, (i, text) in zip(got, want, strict=True):
        ids = _plain(WORDS, text, 1)
        assert (r.doc_id, r.start, r.ids) == (i, at, ids)
        at += len(ids)
    digests = {r.start: r for r in token_files.token_file_digests(folder, manifest).collect()}
    assert all(digests[r.start].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
               and digests[r.start].n_tokens == len(r.ids) for r in got)
    # single-document access, and the dictionary's hash is checked
    dictionary = token_files.read_dictionary(folder)
    one = manifest.orderBy("part", "chunk").collect()[-1]
    f = token_files.TokenFile(one.file, dictionary)
    last = int(f.index["doc_id"][-1])
    assert f.find(last).tolist() == next(r.ids for r in got if r.doc_id == last)
    with pytest.raises(KeyError):
        f.find(1)
    with pytest.raises(ValueError):
        token_files.TokenFile(one.file, b"other")
    # a file that is not in the manifest (a lost attempt's) is not read
    os.rename(one.file.removeprefix("file://"), one.file.removeprefix("file://") + "x")
    with pytest.raises(Exception):  # noqa: B017
        token_files.token_file_digests(folder, manifest).count()


def test_token_files_of_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = f"file://{tmp_path}/none"
    manifest = token_files.write_token_files(df, WORDS, folder)
    assert manifest.count() == 0 and token_files.read_token_files(folder, manifest).count() == 0


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORDS, False)])
def test_control_strings_as_in_the_plain_call(path, spaced):
    plain = Tokenizer.from_file(path)
    texts = ODD_TEXTS + ["x <|endoftext|> y", "<|ENDOFTEXT|> a", "<|startoftext|>hi<|endoftext|>", "no <|end", "<|endoftext|>"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    encoder = PieceEncoder(path, spaced, special=True)
    for _ in range(2):
        got = [x.tolist() for _, x in encoded_rows(encoder, batch, 1)]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_ids_that_do_not_fit_their_width():
    assert token_files.deserialize(token_files.serialize(np.array([65535]), 2), 2).tolist() == [65535]
    assert token_files.deserialize(token_files.serialize(np.array([70000]), 4), 4).tolist() == [70000]
    with pytest.raises(ValueError):
        token_files.serialize(np.array([1, 70000]), 2)


def test_folders_are_full_uris(spark):
    assert token_files.new_folder(spark).startswith("file:/")
