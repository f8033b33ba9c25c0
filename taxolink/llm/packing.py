"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Packing depends on lengths only, so the whole instance
is the number of pieces per length: at most ``capacity`` numbers, whatever the table's size. That bounded
histogram is solved on the driver:

1. *Reduction* (Martello and Toth's dominance criterion): for the longest length left, a set of it and at most
   two shorter pieces is fixed for good when it dominates every other feasible set with that piece: alone when
   nothing fits beside it; with the longest piece that fits when that fills the sequence, or when no three
   pieces fit and no two that fit are together longer.
   Equal sets are fixed in bulk. A length whose sets none dominates is set aside, and the next is tried.
2. *Best fit, descending*, of the remainder: each piece goes into the fullest open sequence that takes it.

Sequences of one kind (the same numbers of pieces per length) are kept as one pattern with a count; the solver's
work depends on the number of lengths only. Every piece then finds its place from its rank among the pieces
of its length, by a join with the table of pattern ranges. That table has a row per pattern and length in it;
:func:`solve` makes at most a few patterns per length, so it stays below a few times ``capacity`` rows.

Ranks need no sort: each task numbers its pieces per length while it tokenizes them, and offsets per (length,
task) are added. The numbered pieces are written once to the shared folder.

Defined results: a null or empty text is a document of the end id alone; repeated rows are separate documents;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolink.llm.tokens import crc32, encoded_rows, worker_encoder
from taxolink.session import write_and_read

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # sequences, ((length, pieces of it per sequence), ...)


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cut ids into pieces: ``capacity`` tokens each, but the first, which takes what is over."""
    over = len(ids) % capacity
    first = over or min(capacity, len(ids))
    yield 0, ids[:first]
    for start in range(first, len(ids), capacity):
        yield start, ids[start:start + capacity]


class _Lengths:
    """Counts per length with fast 'longest one of at most x'."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.sorted = sorted(counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.sorted[bisect.bisect_left(self.sorted, length)]

    def longest(self, most: int) -> int:
        """The longest length of at most ``most``, or 0."""
        i = bisect.bisect_right(self.sorted, most)
        return self.sorted[i - 1] if i else 0

    def best_pair(self, room: int, but: int) -> int:
        """Most tokens that two pieces put into ``room``; one piece of length ``but`` is not there to be taken."""
        lengths = [x for x in self.sorted[:bisect.bisect_right(self.sorted, room)] if self.spare(x, but)]
        i, j, best = 0, len(lengths) - 1, 0
        while i <= j:
            total = lengths[i] + lengths[j]
            if total > room:
                j -= 1
                continue
            if i < j or self.spare(lengths[i], but) > 1:
                best = max(best, total)
            i += 1
        return best

    def spare(self, length: int, but: int) -> int:
        return self.counts[length] - (length == but)

    def three_fit(self, room: int, but: int) -> bool:
        """Whether the three shortest pieces fit into ``room`` together."""
        total = n = 0
        for x in self.sorted:
            k = min(3 - n, self.spare(x, but))
            total, n = total + k * x, n + k
            if n == 3 or total > room:
                break
        return n == 3 and total <= room


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix dominating sets; the fixed patterns and the counts that remain."""
    left, fixed = _Lengths(counts), []
    longest = left.longest(capacity)
    while longest:
        n, room = left.counts[longest], capacity - longest
        mate = left.longest(room)
        if mate == longest and n == 1:
            i = bisect.bisect_left(left.sorted, longest)
            mate = left.sorted[i - 1] if i else 0
        if not mate:
            fixed.append((n, ((longest, 1),)))
            left.take(longest, n)
        elif mate == room or left.best_pair(room, longest) <= mate and not left.three_fit(room, longest):
            if mate == longest:
                times = n // 2
                fixed.append((times, ((longest, 2),)))
                left.take(longest, 2 * times)
            else:
                times = min(n, left.counts[mate])
                fixed.append((times, ((longest, 1), (mate, 1))))
                left.take(longest, times)
                left.take(mate, times)
            if longest in left.counts:
                continue
        else:
            # smaller pieces together may fill more than the best single one: no set dominates
            longest = left.longest(longest - 1)
            continue
        longest = left.longest(longest)
    return fixed, dict(left.counts)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, descending, on counts: sequences that look alike move together."""
    open_by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_by_room:
            bisect.insort(rooms, room)
            open_by_room[room] = []
        open_by_room[room].append(pattern)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                per = capacity // length
                if n >= per:
                    put(capacity - per * length, (n // per, ((length, per),)))
                    n %= per
                if n:
                    put(capacity - n * length, (1, ((length, n),)))
                    n = 0
                continue
            room = rooms[i]
            times, inside = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                del rooms[i]
            per = room // length
            full = min(times, n // per)
            if full:
                put(room - per * length, (full, inside + ((length, per),)))
                n -= full * per
                times -= full
            if n and times:  # fewer than per are left
                put(room - n * length, (1, inside + ((length, n),)))
                n = 0
                times -= 1
            if times:
                put(room, (times, inside))
    return [p for room in rooms for p in open_by_room[room]]


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold exactly the given pieces."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pattern_ranges(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Per pattern and length: ``(length, rank_from, rank_to, sequence_from, per, place)``.

    The piece of rank r among its length's goes into sequence ``sequence_from + (r - rank_from) // per`` at token
    ``place + (r - rank_from) % per * length``.
    """
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for times, inside in patterns:
        place = 0
        for length, per in inside:
            first = rank.get(length, 0)
            rank[length] = first + times * per
            out.append((length, first, rank[length], sequence, per, place))
            place += per * length
        sequence += times
    return out


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, spaced: bool,
                     special: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, nth)``: pieces, numbered per task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = worker_encoder(tokenizer_path, spaced, special), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            row, cols = [], [[], [], [], [], []]
            for i, ids in encoded_rows(encoder, batch, end_id):
                for k, (start, part) in enumerate(pieces_of(ids, capacity)):
                    n = len(part)
                    row.append(i)
                    for col, v in zip(cols, (k, start, n, crc32(part), seen.get(n, 0))):
                        col.append(v)
                    seen[n] = seen.get(n, 0) + 1
            if row:
                piece, start, length, crc, nth = cols
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
         spaced: bool = True, special: bool = False) -> DataFrame:
    """Pack documents ``(doc_id, text)``; one row per piece with its sequence and its place in it."""
    spark = docs.sparkSession
    pieces = write_and_read(tokenized_pieces(docs, tokenizer_path, capacity, end_id, spaced, special), "pack-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.max("nth").alias("n")).withColumn("n", F.col("n") + 1)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = write_and_read(by_task.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
                             .withColumnsRenamed({"length": "of_length", "task": "of_task"}), "pack-counts")
    counts = {r[0]: r[1] for r in by_task.groupBy("of_length").agg(F.sum("n")).collect()}
    table = spark.createDataFrame(pattern_ranges(solve(counts, capacity)),
                                  "at_length long, rank_from long, rank_to long, sequence_from long, per int, place int")
    ranked = (pieces.join(by_task, (F.col("length") == F.col("of_length")) & (F.col("task") == F.col("of_task")))
              .withColumn("rank", F.col("earlier") + F.col("nth")))
    nth = F.col("rank") - F.col("rank_from")
    return (ranked.join(F.broadcast(table), (F.col("length") == F.col("at_length"))
                        & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("sequence_from") + F.floor(nth / F.col("per")).cast("long")).alias("sequence_id"),
                    (F.col("place") + (nth % F.col("per")) * F.col("length")).cast("long").alias("offset")))
