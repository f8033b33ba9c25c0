"""SentencePiece encoding and decoding: byte-pair merges in rounds over flat NumPy arrays.

The model file gives pieces and scores. White space is written as U+2581, one is put before the text, and the text is cut into
words: a run of U+2581 and what follows it up to the next. No piece holds U+2581 after another character (checked when the
model is read), so merges never cross a word. The distinct words of a batch of texts that the worker has not seen are merged
together, in flat arrays of symbols and of word numbers:

* a word is cut further where two characters meet that no piece holds side by side;
* the rank of every neighbouring pair is that of the piece it would make, none across words;
* the smallest rank of each word's pairs is found by a segmented minimum;
* in every word all pairs of that rank are merged at once, from the left, of overlapping ones every second;
* the arrays are compacted, words without a pair leave, ranks beside merged symbols are looked up anew.

This equals one merge at a time (best score first, then leftmost) unless a merged symbol makes, with a neighbour, a pair that
would come before the word's next merge; such words merge in that round up to the first such symbol only. White space
before a word, whose pieces of all lengths share one last rank, is merged by that rule in closed form. Characters
without a piece become byte pieces. The ids of known words are kept per worker and gathered per text.

Two words with one 64-bit hash would be taken for each other: among the :data:`KEEP` words that a worker holds at most, odds of
about one in seventeen million.

Defined results: a null or empty text has only its end id; texts and words of any length are processed whole; rows stay
as they are, repeated ones too; control strings inside texts are ordinary text, as in the library; an empty table gives no
rows; input columns named like added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolink.llm.words import enter, span_hashes, text_chunks

#: Distinct words kept by a Python worker before it starts afresh, and bytes of text handled at a time.
KEEP, CHUNK_BYTES = 1 << 20, 1 << 20
#: Symbols merged together at most (a longer word is merged alone).
FLAT = 1 << 20
SPACE = "▁"
_NONE = np.iinfo(np.int32).max


class MergeTable:
    """Pairs of symbols that make a piece, with the piece and its rank (0: best score); symbols are piece ids."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.library
        self.pieces = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(self.pieces)]
        known = {model.id_to_piece(i): i for i in range(self.pieces) if not special[i]}
        if any(a != SPACE and b == SPACE for p in known for a, b in zip(p, p[1:])):
            raise ValueError("pieces of this model cross words")
        if model.normalize("ﬁ ½  a") != f"{SPACE}ﬁ{SPACE}½{SPACE}{SPACE}a":
            raise ValueError("the model rewrites its texts; only white space and a first space are handled")
        self.end_id = model.eos_id()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        if not all(model.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        # single characters that only occur inside pieces are symbols too, beyond all code points
        inner = sorted({c for p in known for c in p if c not in known})
        self.code_of_char = np.arange(0x110000, dtype=np.int64) + self.pieces  # a character without piece: its code point
        for text, i in known.items():
            if len(text) == 1:
                self.code_of_char[ord(text)] = i
        symbol = {**known, **{c: self.pieces + ord(c) for c in inner}}
        scores = {model.get_score(i) for i in known.values()}
        rank = {s: k for k, s in enumerate(sorted(scores, reverse=True))}
        left, right, made, ranks = [], [], [], []
        for text, i in known.items():
            for cut in range(1, len(text)):
                a, b = symbol.get(text[:cut]), symbol.get(text[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
                    ranks.append(rank[model.get_score(i)])
        self.blank = self._blank_pieces(known, rank)
        joint = sorted({ord(a) << 32 | ord(b) for p in known for a, b in zip(p, p[1:])})
        self.joint = np.append(np.array(joint, dtype=np.int64), np.iinfo(np.int64).max)
        key = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, dtype=np.int64)[order], 0)
        self.rank = np.append(np.array(ranks, dtype=np.int32)[order], _NONE)

    def _blank_pieces(self, known: dict[str, int], rank: dict[float, int]) -> tuple[int, int, np.ndarray] | None:
        """How a run of white space is merged, if its pieces alone share the last rank and no piece has another character
        after two of them: the rank, the longest length, and per length of the rest of a run the pieces where they start
        (-1 elsewhere). Nothing if a run is not whole longest pieces and a rest."""
        blank = {len(p): i for p, i in known.items() if set(p) == {SPACE}}
        most = max(blank, default=0)
        ranks = {rank[self.library.get_score(i)] for n, i in blank.items() if n > 1}
        others = {rank[self.library.get_score(i)] for p, i in known.items() if len(p) > 1 and set(p) != {SPACE}}
        if (most < 2 or 1 not in blank or len(ranks) > 1 or min(ranks) <= max(others, default=-1)
                or any(p[:2] == 2 * SPACE and set(p) != {SPACE} for p in known)):
            return None

        def one_by_one(run: int) -> list[int]:
            parts = [1] * run
            while (at := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in blank), None)) is not None:
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return parts

        if any(one_by_one(n) != [most] * (n // most) + one_by_one(n % most) for n in range(4 * most)):
            return None
        starts = np.full((most, most), -1, np.int64)
        for n in range(most):
            place = 0
            for size in one_by_one(n):
                starts[n, place] = blank[size]
                place += size
        return ranks.pop(), blank[1], np.vstack([starts, np.array([blank[most], *[-1] * (most - 1)])])

    def _blanks_merged(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when the white space of words is merged from the left."""
        _, one, starts = self.blank
        most, blank = starts.shape[1], symbol == one
        first = np.concatenate([[True], ~blank[:-1] | ~blank[1:] | (word[1:] != word[:-1])])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(symbol)))
        run = np.cumsum(first) - 1
        place = np.arange(len(symbol)) - start[run]
        whole = place < size[run] // most * most
        piece = starts[np.where(whole, most, size[run] % most), place % most]
        out = np.where(blank, piece, symbol)
        keep = out >= 0
        return out[keep], word[keep]

    def cuts(self, chars: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where a word begins, or two characters meet that no piece holds side by side."""
        key = chars[:-1] << 32 | chars[1:]
        cut = np.ones(len(chars), bool)
        cut[1:] = (word[1:] != word[:-1]) | (self.joint[np.searchsorted(self.joint, key)] != key)
        return cut

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rank, piece)`` of every pair; no rank for pairs that make no piece."""
        key = left << 32 | right
        at = np.searchsorted(self.key, key)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def merged(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and word numbers (ascending) after all merges."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(symbol), _NONE, np.int32), np.zeros(len(symbol), np.int64)
        if len(symbol) > 1:
            rank[:-1], made[:-1] = self.pairs(symbol[:-1], symbol[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            live = least < _NONE
            if not live.all():
                done.append((symbol[~live], word[~live]))
                symbol, word, rank, made, least = (a[live] for a in (symbol, word, rank, made, least))
                if not len(symbol):
                    break
            if self.blank is not None and (flat := least == self.blank[0]).any():
                done.append(self._blanks_merged(symbol[flat], word[flat]))
                symbol, word, rank, made, least = (a[~flat] for a in (symbol, word, rank, made, least))
                if not len(symbol):
                    break
            take = self._leftmost(np.flatnonzero(rank == least))
            bad = self._unsafe(symbol, word, made, least, take)
            if bad.any():  # in these words the merges up to the first that makes an earlier pair
                start = np.concatenate([[True], word[take][1:] != word[take][:-1]])
                before = np.cumsum(bad) - bad
                before -= before[np.maximum.accumulate(np.where(start, np.arange(len(take)), 0))]
                take = take[before == 0]
            symbol[take] = made[take]
            keep = np.ones(len(symbol), bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, rank, made = (a[keep] for a in (symbol, word, rank, made))
            at = place[take]
            at = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[at] = _NONE
            at = at[at < len(symbol) - 1]
            at = at[word[at] == word[at + 1]]
            rank[at], made[at] = self.pairs(symbol[at], symbol[at + 1])
        if not done:
            return symbol, word
        symbol, word = (np.concatenate(a) for a in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order]

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of pairs at consecutive places, which overlap, every second from the left."""
        new = np.concatenate([[True], at[1:] != at[:-1] + 1])
        start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        return at[(at - start) % 2 == 0]

    def _unsafe(self, symbol: np.ndarray, word: np.ndarray, made: np.ndarray, least: np.ndarray,
                take: np.ndarray) -> np.ndarray:
        """Which merges make a pair, with a neighbour as it is when their turn comes, that comes no later than they do."""
        bad = np.zeros(len(take), bool)
        same = word[take][1:] == word[take][:-1]  # a later merge in the same word: only before one does it matter
        at = np.flatnonzero(same)
        some = take[at]
        # the symbol on the left: of the merge before this one, if that is its neighbour
        left = some - 1
        near = np.zeros(len(at), bool)
        near[at > 0] = take[at[at > 0] - 1] == some[at > 0] - 2
        left[near] -= 1
        inside = left >= 0
        inside[inside] = word[left[inside]] == word[some[inside]]
        beside = np.where(near, made[left], symbol[left])
        rank, _ = self.pairs(beside[inside], made[some[inside]])
        bad[at[inside]] |= rank <= least[some[inside]]
        right = some + 2  # not merged yet; inside the word, as a later merge is there
        rank, _ = self.pairs(made[some], symbol[right])
        bad[at] |= rank <= least[some]
        return bad

    def ids(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their word numbers: characters without a piece as byte pieces."""
        odd = symbol >= self.pieces
        if not odd.any():
            return symbol, word
        code = symbol[odd] - self.pieces
        raw = np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8"), np.uint8)
        times = np.ones(len(symbol), np.int64)
        times[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(symbol, times)
        out[np.repeat(odd, times)] = self.byte_ids[raw]
        return out, np.repeat(word, times)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin with their white space (as spaces), one after another, and their numbers."""
        parts, lo = [], 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= FLAT:
                size += len(texts[hi])
                hi += 1
            joined = "".join(texts[lo:hi]).replace(" ", SPACE)
            chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
            word = np.repeat(np.arange(hi - lo), np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo))
            piece = np.cumsum(self.cuts(chars, word)) - 1  # no merge crosses a cut
            ids, part = self.ids(*self.merged(self.code_of_char[chars], piece))
            of_part = np.zeros(int(piece[-1]) + 1, np.int64)
            of_part[piece] = word
            parts.append((ids.astype(np.int32), np.bincount(of_part[part], minlength=hi - lo)))
            lo = hi
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class WordIds:
    """Ids of the words a worker has met, and the texts made of them."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, at: np.ndarray, hashes: np.ndarray, texts: list[str]) -> None:
        ids, count = self.table.words(texts)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(len(ids), len(self.flat)), np.int32)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.used += len(ids)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a chunk, without end ids, and per text the ids before it (one entry more)."""
        raw = buf.tobytes()
        if SPACE.encode() in raw:  # the mark itself is white space to the model
            texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            raw = b"".join(texts)
            buf = np.frombuffer(raw, np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        buf = np.insert(buf, offsets[full], 0x20)  # the first space of every text that is not empty
        more = np.zeros(len(offsets), np.int64)
        more[full + 1] = 1
        offsets = offsets + np.cumsum(more)
        blank = buf == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buf))
        hashes = span_hashes(buf, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KEEP:
            self._reset()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inner = at < len(self.hashes)
        new[inner] = self.hashes[at[inner]] != distinct[inner]
        if new.any():
            raw, where = buf.tobytes(), where[new]
            self._learn(at[new], distinct[new],
                        [raw[s:e].decode("utf-8") for s, e in zip(starts[where].tolist(), ends[where].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        entry = at[inverse]
        length = self.count[entry]
        upto = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        ids = self.flat[np.repeat(self.first[entry] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]


_WORKER: dict[str, WordIds] = {}


def worker_words(path: str) -> WordIds:
    """This Python worker's words: what it has learnt serves its later tasks too."""
    enter("sentence_pieces", _WORKER.clear)
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def encoded(words: WordIds, batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    """Ids with the end id of every row of a batch, in order."""
    for lo, hi, buf, offsets in text_chunks(batch, column, chunk_bytes=CHUNK_BYTES):
        ids, borders = words.encode(buf, offsets)
        for i in range(hi - lo):
            yield np.append(ids[borders[i]:borders[i + 1]], np.int32(words.table.end_id))


def _others(df: DataFrame, *gone: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in gone]


def _mapped(df: DataFrame, column: str, added: dict[str, str], run) -> DataFrame:
    """``run(batch)`` gives the added columns from a batch that ends with ``column``, which is dropped."""
    names = _others(df, column, *added)
    schema = ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), *(f"{n} {t}" for n, t in added.items())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *run(part.column(len(names)))], names=[*names, *added])

    return df.select(*names, F.col(column)).mapInArrow(batches, schema)


def _as_batch(col: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([col], names=["text"])


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace the text by its ids, the end id last; one pass, no shuffle."""
    def run(col: pa.Array) -> list[pa.Array]:
        rows = list(encoded(worker_words(path), _as_batch(col)))
        upto = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))]
    return _mapped(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, {ids_col: "array<int>"}, run)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replace ids by the text that the model's library decodes from them; null ids give an empty text."""
    def run(col: pa.Array) -> list[pa.Array]:
        library = worker_words(path).table.library
        return [pa.array([library.decode(ids.as_py() or []) for ids in col], pa.string())]
    return _mapped(rows, ids_col, {text_col: "string"}, run)


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Replace the text by ``n_tokens``, ``ids_sha256`` (decimal ids joined by a space) and ``decoded_sha256``."""
    def run(col: pa.Array) -> list[pa.Array]:
        words = worker_words(path)
        n, of_ids, of_text = [], [], []
        for ids in encoded(words, _as_batch(col)):
            ids = ids.tolist()
            n.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(words.table.library.decode(ids).encode("utf-8")).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
    return _mapped(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col,
                   {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, run)
