"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Equal vectors are one class from the start. Classes go to the cell of their nearest center. A pair above the
threshold may lie on both sides of a border between cells, so a class also visits each cell of a smaller number whose border
it is close enough to: for unit vectors x in cell h and y in cell g with angle(x, y) <= a, the distance of x from
the plane between the centers is at most sin(a), that is ``x . (h - g) / |h - g| <= sin(a)``. With these visits no pair is
lost, and each pair is compared once: inside its cell, or as a visitor in the smaller of the two cells.

Cells are cut into blocks of about :data:`BLOCK` classes; a task multiplies two blocks. Pairs within 1e-9 of the threshold are decided
by their own cosine on the original vectors. It returns the links of each class and
a spanning forest of the links, not the pairs. Components are joined by :mod:`taxolink.llm.components`.

Centers are fitted on at most :data:`SAMPLE` vectors on the driver; that bounds their number too. There is one per
:data:`CELL_ROWS` classes, and :data:`MIN_CELLS` at least (fewer only below 8 classes a center).

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, and so do vectors
of another length than most, and rows with a null id (component null); repeated rows are vectors of their own;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolink.llm.components import connected_components
from taxolink.llm.vectors import common_width, cosine, matrix, sample, spherical_kmeans, unit, usable
from taxolink.session import write_and_read

SAMPLE, MIN_CELLS, MAX_CELLS, CELL_ROWS, BLOCK = 32768, 8, 2048, 4096, 4096
#: Rows of a block multiplied at a time; distance from the threshold within which a pair's cosine is computed by itself.
STRIP, EDGE = 512, 1e-9


def place(x: np.ndarray, centers: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, home?)`` of unit rows: their own cell and the cells they visit."""
    dots = x @ centers.T
    home = np.argmax(dots, axis=1)
    gap = np.take_along_axis(dots, home[:, None], 1) - dots
    apart = np.linalg.norm(centers[:, None, :] - centers[None, :, :], axis=2) if len(centers) <= 256 else np.sqrt(
        np.maximum(0, 2 - 2 * centers @ centers.T))
    near = gap <= apart[home] * np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    near &= np.arange(len(centers))[None, :] < home[:, None]
    row, cell = np.nonzero(near)
    return (np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell]),
            np.concatenate([np.ones(len(x), bool), np.zeros(len(row), bool)]))


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a block of links, as (id, smallest id of its tree) for all but the roots."""
    out = []
    todo = linked.any(axis=1)
    rows_seen = np.zeros(len(left), bool)
    cols_seen = np.zeros(len(right), bool)
    for r in np.flatnonzero(todo):
        if rows_seen[r]:
            continue
        rows = np.zeros(len(left), bool)
        rows[r] = True
        cols = np.zeros(len(right), bool)
        fresh = rows.copy()
        while fresh.any():
            new_cols = linked[fresh].any(axis=0) & ~cols
            cols |= new_cols
            fresh = linked[:, new_cols].any(axis=1) & ~rows
            rows |= fresh
        rows_seen |= rows
        cols_seen |= cols
        ids = np.unique(np.concatenate([left[rows], right[cols]]))
        out.extend((int(i), int(ids[0])) for i in ids[1:])
    return out


def _compare(threshold: float, width: int):
    """Links inside a block (one side) or between a block and a block of the same cell."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        def column(name):
            col = table.column(name)
            return col.chunk(0) if col.num_chunks else pa.array([], col.type)
        ids = column("id").to_numpy(zero_copy_only=False)
        copies = column("copies").to_numpy(zero_copy_only=False)
        second = column("second").to_numpy(zero_copy_only=False).astype(bool)
        raw = matrix(column("vector"), width)
        x = unit(raw)
        same = not second.any()
        a, b = (slice(None), slice(None)) if same else (~second, second)
        left, right = ids[a], ids[b]
        xa, xb, raw_a, raw_b = x[a], x[b], raw[a], raw[b]
        linked = np.empty((len(xa), len(xb)), bool)
        of_left, of_right = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
        for lo in range(0, len(xa), STRIP):
            strip = linked[lo:lo + STRIP]
            dots = xa[lo:lo + STRIP] @ xb.T
            np.greater_equal(dots, threshold, out=strip)
            # near the threshold the pair's own cosine decides: it does not depend on the block it is in
            i, j = np.nonzero(np.abs(dots - threshold) < EDGE)
            for at in range(0, len(i), 1 << 16):
                r, c = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                strip[r, c] = cosine(raw_a[lo + r], raw_b[c]) >= threshold
            if same:
                strip[np.arange(len(strip)), lo + np.arange(len(strip))] = False
            i, j = np.nonzero(strip)
            np.add.at(of_left, lo + i, copies[b][j])
            if not same:
                np.add.at(of_right, j, copies[a][lo + i])
        parent = dict(forest(linked, left, right))
        found = [*zip(left.tolist(), of_left.tolist()), *([] if same else zip(right.tolist(), of_right.tolist()))]
        rows = [(i, parent.get(i, i), n) for i, n in found if n]
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()),
                         "n_links": pa.array([r[2] for r in rows], pa.int64())})
    return run


def class_links(classes: DataFrame, threshold: float, width: int) -> DataFrame:
    """``(a, b, n_links)`` from classes ``(id, vector, copies)``: links of a in one block, b its tree's root there."""
    spark = classes.sparkSession
    n = classes.count()
    some = unit(sample(classes, "vector", "id", SAMPLE, width)) if n else np.zeros((0, width))
    centers = spherical_kmeans(some, max(1, min(MAX_CELLS, max(MIN_CELLS, n // CELL_ROWS), len(some) // 8))) if n else some
    sent = spark.sparkContext.broadcast(centers)

    def cells(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(1), width))
            for lo in range(0, len(x), 1024):
                row, cell, home = place(x[lo:lo + 1024], sent.value, threshold)
                part = batch.slice(lo, 1024).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(home)],
                                                 names=["id", "vector", "copies", "cell", "home"])

    placed = write_and_read(
        classes.select("id", "vector", "copies").mapInArrow(
            cells, "id long, vector array<float>, copies long, cell int, home boolean"), "dedup-cells")
    # blocks per cell: a table of at most MAX_CELLS rows
    per = placed.groupBy("cell").agg(F.sum(F.when(F.col("home"), 1).otherwise(0)).alias("homes"),
                                     F.sum(F.when(F.col("home"), 0).otherwise(1)).alias("visits"))
    per = per.select("cell", F.greatest(F.lit(1), F.ceil(F.col("homes") / BLOCK)).alias("home_blocks"),
                     F.greatest(F.lit(1), F.ceil(F.col("visits") / BLOCK)).alias("visit_blocks"))
    per = F.broadcast(write_and_read(per, "dedup-blocks"))
    rows = placed.join(per, "cell")
    block = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("home_blocks")).otherwise(F.col("visit_blocks")))
    rows = rows.withColumn("block", block)
    last = F.col("home_blocks") - 1

    def unit_of(kind: str, i, j, second: bool):
        return F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"),
                        F.lit(second).alias("second"))

    me = F.col("block")
    up_to = F.sequence(F.lit(0).cast("long"), last)
    as_home = F.concat(
        F.transform(F.filter(up_to, lambda k: k >= me), lambda k: unit_of("home", me, k, False)),
        F.transform(F.filter(up_to, lambda k: k < me), lambda k: unit_of("home", k, me, True)),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("visit_blocks") - 1),
                    lambda k: unit_of("visit", k, me, False)))
    as_visit = F.transform(up_to, lambda k: unit_of("visit", me, k, True))
    units = rows.withColumn("u", F.explode(F.when(F.col("home"), as_home).otherwise(as_visit)))
    units = units.select("id", "vector", "copies", "cell", "u.*")
    return units.groupBy("cell", "kind", "i", "j").applyInArrow(_two_sided(threshold, width),
                                                                "a long, b long, n_links long")


def _two_sided(threshold: float, width: int):
    """Compare a unit's blocks; a unit of two blocks of which one is empty has no links."""
    compare = _compare(threshold, width)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        two_sided = kind == "visit" or i != j
        second = table.column("second")
        if two_sided and (not any(second.to_pylist()) or all(second.to_pylist())):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n_links")})
        return compare(key, table)
    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row: links with other rows from ``threshold`` on."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    width = common_width(rows.filter(usable(F.col("vector"))), "vector")
    takes_part = usable(F.col("vector")) & (F.size("vector") == width) & F.col("id").isNotNull()
    some = rows.filter(takes_part)
    classes = write_and_read(some.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")),
                             "dedup-classes")
    links = write_and_read(class_links(classes, threshold, width), "dedup-links")
    roots = connected_components(links)
    counts = links.groupBy("a").agg(F.sum("n_links").alias("others"))
    named = classes.select(F.col("id").alias("class"), "copies")
    per = named.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    smallest = per.groupBy(F.col("root").alias("of_root")).agg(F.min("class").alias("component_id"))
    per = (per.join(smallest, F.col("root") == F.col("of_root")).join(counts, F.col("class") == F.col("a"), "left")
           .select("class", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    per = write_and_read(per, "dedup-result")
    found = write_and_read(classes.select(F.col("vector").alias("v"), F.col("id").alias("class")).join(per, "class")
                           .select("v", "component_id", "n_links"), "dedup-result")
    linked = some.join(found, F.col("vector") == F.col("v"))
    linked = linked.select("id", "n_links", "component_id")
    alone = rows.filter(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
