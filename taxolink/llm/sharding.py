"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``vnodes`` points on a ring of 65,536 cells; a document hashes to a cell and belongs
to the next point clockwise (its arc). Each shard takes at most its capacity: capacities are
``floor(rows / shards)`` or one more and add up to the number of rows, so every shard ends exactly full and
counts are at most one apart. Documents that overflow a full shard go on clockwise, arc by arc, to
the next shard with room; the others stay where the ring puts them, which limits movement when shards come or go.

Only counts per arc (at most ``shards * vnodes`` numbers, whatever the table's size) reach the driver. The
walk over them yields, per arc, ranges of ranks with their shard and first slot (at most
``shards * (vnodes + 1)`` rows, each either an arc's own range or one filled up by an overflow);
that bounded table is broadcast. A document finds its range by its rank in its arc.

Defined results: a null text counts as empty; a null key hashes like the word ``null``; repeated rows and
equal keys share an arc and are ranked by text checksum, then arbitrarily among identical rows (any such
choice gives the same output rows); an empty table gives no rows. Extra columns stay untouched, except
that input columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16


def cell_of(key: Column) -> Column:
    """Ring cell of a key: the first 16 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 4),
                  16, 10).cast("int")


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted ``(cell, shard)`` points; a cell wanted by two shards goes to the smaller one."""
    points: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:4], 16)
            points.setdefault(cell, s)
    return sorted(points.items())


def arc_table(points: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """``(cell, arc)`` for every cell: the index of the next point clockwise."""
    out, arc = [], 0
    for cell in range(CELLS):
        while arc < len(points) and points[arc][0] < cell:
            arc += 1
        out.append((cell, arc if arc < len(points) else 0))
    return out


def place_arcs(counts: dict[int, int], points: Sequence[tuple[int, int]],
               shards: int) -> list[tuple[int, int, int, int, int]]:
    """Bounded-load walk over arc counts: ``(arc, first rank, end rank, shard, first slot)`` ranges.

    First every arc gives its own shard what fits, in ring order; then the overflow moves clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    left, ranges = {}, []

    def take(arc: int, first: int, n: int, shard: int) -> None:
        ranges.append((arc, first, first + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    for arc, (_, shard) in enumerate(points):
        n = min(counts.get(arc, 0), room[shard])
        if n:
            take(arc, 0, n, shard)
        if counts.get(arc, 0) > n:
            left[arc] = n
    for arc, first in left.items():
        at = arc
        while first < counts[arc]:
            at = (at + 1) % len(points)
            shard = points[at][1]
            n = min(counts[arc] - first, room[shard])
            if n:
                take(arc, first, n, shard)
                first += n
            elif at == arc:  # shards without a point of their own (all their cells were taken)
                shard = next(s for s in range(shards) if room[s])
                n = min(counts[arc] - first, room[shard])
                take(arc, first, n, shard)
                first += n
    return ranges


def assign_shards(df: DataFrame, key: str = "doc_id", tie: Sequence[Column] = (),
                  shards: int = 24, vnodes: int = 64) -> DataFrame:
    """Add ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard) to every row of ``df``.

    ``tie`` orders rows with equal keys. Two passes over the keys (counts, then ranks) and one shuffle of
    the rows by arc.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", "ring_cell", "ring_arc", "ring_rank", "rank_from", "rank_to", "slot_from")
    points = ring_points(shards, vnodes)
    cells = spark.createDataFrame(arc_table(points), "ring_cell int, ring_arc int")
    placed = df.withColumn("ring_cell", cell_of(F.col(key))).join(F.broadcast(cells), "ring_cell")
    counts = {r[0]: r[1] for r in placed.groupBy("ring_arc").agg(F.count(F.lit(1))).collect()}
    ranges = spark.createDataFrame(
        place_arcs(counts, points, shards),
        "ring_arc int, rank_from long, rank_to long, shard int, slot_from long")
    order = Window.partitionBy("ring_arc").orderBy("ring_cell", F.md5(F.col(key).cast("string").cast("binary")),
                                                   *tie)
    ranked = placed.withColumn("ring_rank", (F.row_number().over(order) - 1).cast("long"))
    hit = ((ranked["ring_arc"] == ranges["ring_arc"]) & (F.col("ring_rank") >= F.col("rank_from"))
           & (F.col("ring_rank") < F.col("rank_to")))
    return (ranked.join(F.broadcast(ranges), hit)
            .withColumn("slot", F.col("slot_from") + F.col("ring_rank") - F.col("rank_from"))
            .select(*df.columns, "shard", "slot"))
