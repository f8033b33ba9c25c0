"""Token ids of whole texts by the ``tokenizers`` library, one call per distinct piece of text.

Byte-pair encoding never merges across the borders its pre-tokenizer sets, and the pre-tokenizers of both
public vocabularies used here always set one where white space begins. So a text's ids are its pieces' ids,
one after another, where a piece is the white space before a word and the word. Pieces are found and hashed
with array steps (:mod:`taxolink.llm.words`); every distinct piece of a worker is encoded once by the library
and its ids are kept; a text's ids are then gathered. Texts with white space outside ASCII, which may join
with its neighbours, are encoded whole.

Two different pieces with one 64-bit hash would be taken for each other; among the at most
:data:`KEEP` pieces that a worker holds that has odds of about one in four million.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from taxolink.llm.words import enter, span_hashes, text_chunks, word_spans

#: Distinct pieces kept by a Python worker before it starts afresh.
KEEP = 5 << 18
#: Bytes of text handled at a time.
CHUNK_BYTES = 2 << 20
#: White space outside ASCII, as one class.
_OTHER_SPACE = re.compile("[\u0085   -     　\x1c-\x1f]")


class PieceEncoder:
    """Encode Arrow texts with a ``tokenizers`` file; ``spaced`` if its pieces carry their white space.

    Pieces that differ in ASCII case only are one piece when the file's normalizer folds case. Control strings (the file's
    added tokens) inside a text are ordinary text, or with ``special`` their tokens, as in the library's plain call; texts
    that hold one are then encoded whole.
    """

    def __init__(self, path: str, spaced: bool, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.added = [t for t in added if t]
        self.spaced = spaced
        self.folded = "Lowercase" in repr(self.tokenizer.normalizer)
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of the known pieces, sorted
        self.first = np.zeros(0, np.int64)    # per known piece: place of its ids in flat
        self.count = np.zeros(0, np.int32)    # and their number
        self.odd = np.zeros(0, bool)          # holds white space outside ASCII
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _holding_added(self, buf: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts with the string of an added token, whatever its case."""
        raw = buf.tobytes().lower()
        if not any(t in raw for t in self.added):
            return []
        return [i for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())) if any(t in raw[a:b] for t in self.added)]

    def _learn(self, at: np.ndarray, hashes: np.ndarray, raw: bytes, starts: list[int], ends: list[int]) -> None:
        """Encode the new pieces ``raw[start:end]``; ``at`` is where their (ascending) hashes go among the known ones."""
        counts, odd, first = [], [], self.used
        for lo in range(0, len(starts), 4096):  # the library's result objects are large
            pieces = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[lo:lo + 4096], ends[lo:lo + 4096])]
            ids = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(count.sum())
            if self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, max(self.used + total, 2 * len(self.flat)))
            self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.used += total
            counts.append(count)
            odd.append(np.fromiter((_OTHER_SPACE.search(p) is not None for p in pieces), bool, len(pieces)))
        count = np.concatenate(counts)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, first + np.cumsum(count, dtype=np.int64) - count)
        self.count = np.insert(self.count, at, count)
        self.odd = np.insert(self.odd, at, np.concatenate(odd))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of one chunk, and per text the number of ids before it (one entry more)."""
        starts, ends, before = word_spans(buf, offsets)
        if self.spaced:
            # a piece starts where the word before it, or the text, ends; white space at a text's end is a piece
            n_texts = len(offsets) - 1
            begins = np.empty_like(starts)
            if len(starts):
                begins[0] = 0
                begins[1:] = ends[:-1]
                begins = np.maximum(begins, offsets[np.searchsorted(offsets, starts, side="right") - 1])
            last_end = offsets[:-1].copy()
            full = before[1:] > before[:-1]
            last_end[full] = ends[before[1:][full] - 1]
            tail = np.flatnonzero(last_end < offsets[1:])
            if len(tail):
                at = before[1:][tail]
                begins = np.insert(begins, at, last_end[tail])
                ends = np.insert(ends, at, offsets[1:][tail])
                more = np.zeros(n_texts + 1, np.int64)
                more[tail + 1] = 1
                before = before + np.cumsum(more)
            starts = begins
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = span_hashes(buf, starts, ends, lower=self.folded)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KEEP:
            self._reset()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inner = at < len(self.hashes)
        new[inner] = self.hashes[at[inner]] != distinct[inner]
        if new.any():
            where = where[new]
            self._learn(at[new], distinct[new], buf.tobytes(), starts[where].tolist(), ends[where].tolist())
            at = np.searchsorted(self.hashes, distinct)
        entry = at[inverse]
        length = self.count[entry].astype(np.int64)
        upto = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        ids = self.flat[np.repeat(self.first[entry] - upto[:-1], length) + np.arange(upto[-1])]
        borders = upto[before]
        odd = np.flatnonzero(self.odd[entry])
        texts = np.unique(np.searchsorted(before, odd, side="right") - 1)
        if self.added:
            texts = np.union1d(texts, self._holding_added(buf, offsets)).astype(np.int64)
        if len(texts):
            per = np.split(ids, borders[1:-1])
            for t in texts:
                per[t] = self.whole(buf[offsets[t]:offsets[t + 1]].tobytes().decode("utf-8", "replace"))
            ids = np.concatenate(per).astype(np.uint32)
            borders = np.concatenate([[0], np.cumsum([len(p) for p in per])])
        return ids, borders


_ENCODERS: dict[tuple[str, bool, bool], PieceEncoder] = {}


def worker_encoder(path: str, spaced: bool, special: bool = False) -> PieceEncoder:
    """This Python worker's encoder: the pieces it has learnt serve its later tasks too."""
    enter("tokens", _ENCODERS.clear)
    key = path, spaced, special
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def encoded_rows(encoder: PieceEncoder, batch: pa.RecordBatch, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row number, ids with the end id)`` for every row of a batch with a ``text`` column."""
    for lo, hi, buf, offsets in text_chunks(batch, chunk_bytes=CHUNK_BYTES):
        ids, borders = encoder.encode(buf, offsets)
        for i in range(hi - lo):
            out = np.empty(borders[i + 1] - borders[i] + 1, np.uint32)
            out[:-1] = ids[borders[i]:borders[i + 1]]
            out[-1] = end_id
            yield lo + i, out


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
