"""Spelling variant grouping by one-edit neighbourhoods over a reduced alphabet.

Words are counted over whole texts: maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z lowered. A seeded fault deletes a
letter of some runs: where 199 divides ``h``, the crc32 of ``<doc_id>:<lowered run>``, the code point at ``h % length``
goes. Counts are made per task before they are shuffled.

Letters are then hashed to a few symbols by a table balanced over their frequencies. Of every distinct reduced word the full
neighbourhood is generated: itself, every deletion, insertion and replacement of one symbol, as 64-bit keys (each from the
word's key in one step, so long words cost their length, not its square). Neighbours join the reduced vocabulary; the words
behind each pair of reduced words are verified on the original strings. Words that differ by one edit are reduced to
equal words or to words one edit apart, so no pair is lost, and the verification drops what hashing adds. A bitmap of
fixed size, with a bit for each reduced word, drops most neighbours that are none before the join.

Few symbols make neighbourhoods small and reduced words alike. The number of symbols is the smallest of :data:`SYMBOLS` for
which at most one in :data:`ALIKE` words shares its reduced form by chance, or else the number of letters, where no two do.

Each word's form is its near word of largest count, if that is five times its own or more; forms are followed by
pointer doubling, in rounds as many as the logarithm of the longest chain (counts grow five times a step).

Defined results: null and empty texts have no words; a null id counts as an empty string in the hash; rows that share an
id count one by one; texts and words of any length are processed whole; among near words with equal counts the smallest in
code-point order is the form; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolink.llm.words import _LOWER as LOWER
from taxolink.llm.words import enter, mix, span_hashes, text_chunks
from taxolink.session import write_and_read

#: The fault of the counted words: one in FAULT runs, by hash, loses a letter.
FAULT = 199
SYMBOLS, ALIKE = (4, 8, 16, 32, 64), 16
#: Bits of the map of reduced words, as a power of two (8 MB), in rows of 2**15 bits.
MAP_BITS, ROW_BITS = 26, 15
#: Distinct words a task holds before it passes counts on; neighbour keys of a batch.
HELD, KEYS = 1 << 18, 1 << 18

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def run_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all letter runs of the texts of one chunk."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = buf == _LEAD
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    at = edges[edges < n]
    first[at] = inside[at]
    at = edges[edges > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of every lowered span, carried on from the crc32 ``seeds`` of what stands before it."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    out = np.empty(len(starts), np.uint32)
    long = order[:int(np.searchsorted(-length[order], -64, side="left"))]  # more than 64 bytes: one by one
    for k in long.tolist():
        out[k] = zlib.crc32(buf[starts[k]:ends[k]].tobytes().lower(), int(seeds[k]))
    order = order[len(long):]
    at, size = starts[order], length[order]
    state = ~seeds[order]
    for j in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -j, side="left"))
        state[:m] = _CRC[(state[:m] ^ LOWER[buf[at[:m] + j]]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out[order] = ~state
    return out


def _counting(least: int):
    """Counts of the words with ``least`` code points or more, per task; input ``(id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        counts: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = pa.array([w.decode("utf-8") for w in counts], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in text_chunks(batch):
                starts, ends = run_spans(buf, offsets)
                if not len(starts):
                    continue
                before = np.zeros(len(buf) + 1, np.int64)
                np.cumsum(buf == _LEAD, out=before[1:])
                size = ends - starts - (before[ends] - before[starts])
                some = size >= least
                starts, ends, size = starts[some], ends[some], size[some]
                prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.slice(lo, hi - lo).to_pylist()],
                                  dtype=np.uint32)
                text = np.searchsorted(offsets, starts, side="right") - 1
                crc = run_crcs(buf, starts, ends, prefix[text])
                fault = crc % FAULT == 0
                for s, e, n, h in zip(starts[fault].tolist(), ends[fault].tolist(), size[fault].tolist(), crc[fault].tolist()):
                    if n > least:
                        word = buf[s:e].tobytes().lower().decode("utf-8")
                        counts[(word[:h % n] + word[h % n + 1:]).encode("utf-8")] += 1
                starts, ends = starts[~fault], ends[~fault]
                _, where, times = np.unique(span_hashes(buf, starts, ends, lower=True), return_index=True, return_counts=True)
                raw = buf.tobytes()
                for s, e, n in zip(starts[where].tolist(), ends[where].tolist(), times.tolist()):
                    counts[raw[s:e].lower()] += n
                if len(counts) > HELD:
                    yield passed_on()
        yield passed_on()
    return run


def count_words(docs: DataFrame, least_chars: int = 6, least_count: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``(word, n)``: all words of at least ``least_chars`` code points and ``least_count`` occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(_counting(least_chars), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _symbols(letters: list[tuple[str, int]], most: int) -> dict[str, int]:
    """Letters to at most ``most`` symbols, heavy letters first, each to the symbol with the least weight."""
    weight = [0] * most
    out = {}
    for letter, n in sorted(letters, key=lambda x: (-x[1], x[0])):
        out[letter] = weight.index(min(weight))
        weight[out[letter]] += n
    return out


def _code(table: dict[str, int]) -> Column:
    """A word's reduced form; symbols are written as the characters from U+0100 on."""
    return F.translate("word", "".join(table), "".join(chr(0x100 + s) for s in table.values()))


def reduced_alphabet(words: DataFrame) -> dict[str, int]:
    """The table from letters to symbols. The driver gets at most 90 letters and their weights."""
    letters = [(r["c"], r["n"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''")
               .groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()]
    total = words.count()
    for most in SYMBOLS:
        if most >= len(letters):
            break
        table = _symbols(letters, most)
        alike = (words.groupBy(_code(table).alias("code")).agg(F.count(F.lit(1)).alias("k"))
                 .agg(F.sum(F.col("k") * (F.col("k") - 1))).first()[0])
        if alike * ALIKE <= total:
            return table
    return _symbols(letters, max(1, len(letters)))


class Codes:
    """Flat symbol arrays of a batch of reduced words, and their keys: sums of ``value[symbol] * base**place``, mixed."""

    def __init__(self, codes: list[str]):
        self.count = len(codes)
        flat = np.frombuffer("".join(codes).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) - 0x100
        self.length = np.fromiter(map(len, codes), np.int64, self.count)
        self.first = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(self.count), self.length)
        self.symbol = flat
        self.place = np.arange(len(flat)) - self.first[self.word]
        step = np.full(int(self.length.max(initial=0)) + 2, _BASE, dtype=np.uint64)
        step[0] = 1
        self.power = np.multiply.accumulate(step)
        self.term = self.value(flat) * self.power[self.place]
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(self.term, out=sums[1:])
        self.before = sums[:-1] - sums[self.first][self.word]      # per symbol: sum of the terms before it in its word
        self.total = sums[self.first + self.length] - sums[self.first]

    @staticmethod
    def value(symbol: np.ndarray) -> np.ndarray:
        return mix((np.asarray(symbol).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def _key(self, total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(total + length.astype(np.uint64) * _LENGTH).view(np.int64)

    def own(self) -> np.ndarray:
        return self._key(self.total, self.length)

    def neighbours(self, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(word number, key)`` of all one-edit neighbours, each distinct neighbour of a word once, a block at a time."""
        values = self.value(np.arange(symbols))
        block = max(1, KEYS // (2 * symbols + 1))
        for lo in range(0, len(self.symbol), block):
            at = slice(lo, lo + block)
            word, symbol, before, place = self.word[at], self.symbol[at], self.before[at], self.place[at]
            total, power, size = self.total[word], self.power[place], self.length[word]
            after = total - before - self.term[at]
            for s in range(symbols):
                other = symbol != s
                yield word[other], self._key(
                    (total + (values[s] - values[symbol]) * power)[other], size[other])  # replaced
                # inserted before this symbol; before an equal symbol it is the same word as after it
                yield word[other], self._key(
                    (before + values[s] * power + (total - before) * _BASE)[other], size[other] + 1)
            ends = np.ones(len(word), bool)  # of equal neighbours in a row the last goes
            nxt = np.arange(lo, min(lo + block, len(self.symbol))) + 1
            inner = nxt < len(self.symbol)
            same = self.word[nxt[inner]] == word[inner]
            ends[np.flatnonzero(inner)[same & (self.symbol[nxt[inner]] == symbol[inner])]] = False
            yield word[ends], self._key((before + after * _BACK)[ends], size[ends] - 1)  # deleted
        everyone = np.arange(self.count)
        for s in range(symbols):  # inserted at the end
            yield everyone, self._key(self.total + values[s] * self.power[self.length], self.length + 1)


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("spelling")
    for batch in batches:
        if batch.num_rows:
            codes = Codes(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.own())], names=["word", "n", "code", "own"])


def _neighbours(symbols: int, known: np.ndarray):
    """``(own, key)`` from ``(own, code)``: neighbours whose bit is set in the map of reduced words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                own = part.column(0).to_numpy()
                for word, key in Codes(part.column(1).to_pylist()).neighbours(symbols):
                    bit = key.view(np.uint64) >> np.uint64(64 - MAP_BITS)
                    there = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0
                    mine, key = own[word[there]], key[there]
                    less = mine < key  # each pair of reduced words from its smaller key only
                    yield pa.RecordBatch.from_arrays([pa.array(mine[less]), pa.array(key[less])], names=["own", "key"])
    return run


def _bit_map(reduced: DataFrame) -> np.ndarray:
    """A bit for the leading :data:`MAP_BITS` bits of every key; its rows, of 4 KB, are built by Spark."""
    bit = F.shiftrightunsigned("own", 64 - MAP_BITS)
    rows = (reduced.groupBy(F.shiftright(bit, ROW_BITS).cast("int").alias("row"))
            .agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("bits")))
    out = np.zeros((1 << (MAP_BITS - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for r in rows.toLocalIterator():
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: every pair of words one edit apart, both ways; ``words``: distinct ``(word, n)``."""
    spark = words.sparkSession
    table = reduced_alphabet(words)
    coded = words.select("word", "n", _code(table).alias("code"))
    coded = write_and_read(coded.mapInArrow(_own_keys, "word string, n long, code string, own long"), "spelling-codes")
    reduced = write_and_read(coded.groupBy("own").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("members")),
                             "spelling-reduced")
    known = spark.sparkContext.broadcast(_bit_map(reduced))
    symbols = max(table.values(), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _neighbours(symbols, known.value)(batches)

    found = reduced.select("own", "code").mapInArrow(run, "own long, key long")
    pairs = found.join(reduced.select(F.col("own").alias("key")), "key").select("own", "key").distinct()
    pairs = pairs.union(reduced.filter("members > 1").select("own", F.col("own").alias("key")))
    one = coded.select("own", "word", "n")
    two = coded.select(F.col("own").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # equal reduced words: each pair of originals once; verified on the original strings
    near = (pairs.join(one, "own").join(two, "key")
            .filter((F.col("own") != F.col("key")) | (F.col("word") < F.col("other")))
            .filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n"))
    near = write_and_read(near, "spelling-near")
    return near.union(near.select("other", "other_n", "word", "n"))


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` from distinct ``(word, n)``."""
    words = write_and_read(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left")
    has = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    out = write_and_read(out, "spelling-forms")
    ups = out.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("up"))
    while True:  # pointer doubling: each round looks twice as far
        jump = ups.select(F.col("word").alias("at"), F.col("up").alias("far"))
        ups = write_and_read(ups.join(jump, F.col("up") == F.col("at"), "left")
                             .select("word", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")),
                             "spelling-roots")
        if ups.filter("moved").isEmpty():
            break
    return out.join(ups.select("word", "up"), "word", "left").select(
        "word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_chars: int = 6, least_count: int = 5, times: int = 5,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of whole texts with their near words' number, form and root."""
    return variants(count_words(docs, least_chars, least_count, id_col, text_col), times)
