"""Beam search scored from texts (M6 → A7): a sparse inner-product join that never holds a record × class table.

Class vectors are an inverted index below each parent: ``(parent, term) → postings (child, weight)`` with the largest weight of
each list. A record on the frontier probes it term by term. All weights are positive, so ``weight × largest weight`` bounds what
a term can add, and the search of one (record, parent) runs in two steps:

* *strong* terms, those with the largest bounds that together reach :data:`STRONG` of the sum of all bounds, are joined with
  the postings and give partial scores; their k-th best is a threshold, and the bounds of the other terms add up to ``rest``;
* where the threshold is above ``rest``, only children whose partial score plus ``rest`` reaches it can be among the k best. Their
  scores are completed from their own term lists. Elsewhere the remaining terms are joined with their postings too.

Frequent terms have small inverse document frequencies, hence small bounds: they are weak, and their long postings are
read only for the few records that stay open. A key of the probe join is one (parent, term) with one row of postings on the
index side, so a hot term is a skewed probe side only, which AQE splits.

These joins move a record's vector once per level and form a row per (record, parent, term). A hierarchy of at most
:data:`TREE` entries and :data:`WIDE` entries below each parent is sent out instead, and every record walks down it in its own row:
its vector moves once, and only the products of children of chosen nodes are formed. Below so few children, bounds save nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolink.session import write_and_read

#: Parent of the roots.
ROOT = -1
#: Share of the sum of bounds that the strong terms reach.
STRONG = 0.5
#: Scores are rounded to so many decimals before they are ranked, so that sums in another order rank alike.
DECIMALS = 9
_SLACK = 1e-9
#: Most entries (vector entries and edges) of a hierarchy that is sent out, in all and below one parent.
TREE, WIDE = 1 << 22, 1 << 14
#: Weights of a group of records that lie open at once, pairs of it with children, and products that are formed at once.
_CELLS = 1 << 20


def inverted_index(class_vectors: DataFrame, down: DataFrame) -> DataFrame:
    """``(parent, term_id, top, postings)`` from ``(class_idx, term_id, weight)`` and ``(parent, child)``."""
    below = class_vectors.join(down, F.col("class_idx") == F.col("child"))
    return below.filter("weight > 0").groupBy("parent", "term_id").agg(
        F.max("weight").alias("top"), F.collect_list(F.struct("child", "weight")).alias("postings"))


def probe_terms(frontier: DataFrame, record_vectors: DataFrame, index: DataFrame) -> DataFrame:
    """Terms of frontier records that occur below their parent: ``(row_id, parent, term_id, w, strong, rest)``."""
    hit = (frontier.select("row_id", "parent").join(record_vectors, "row_id")
           .join(index.select("parent", "term_id", "top"), ["parent", "term_id"])
           .select("row_id", "parent", "term_id", F.col("weight").alias("w"), (F.col("weight") * F.col("top")).alias("bound")))
    group = Window.partitionBy("row_id", "parent")
    order = group.orderBy(F.desc("bound"), "term_id").rowsBetween(Window.unboundedPreceding, -1)
    # the ordered window first: its sort serves the other two
    hit = hit.withColumn("before", F.coalesce(F.sum("bound").over(order), F.lit(0.0))).withColumn("total", F.sum("bound").over(group))
    hit = hit.withColumn("strong", F.col("before") < STRONG * F.col("total"))
    rest = F.sum(F.when(F.col("strong"), 0.0).otherwise(F.col("bound"))).over(group)
    return hit.select("row_id", "parent", "term_id", "w", "strong", rest.alias("rest"))


def _products(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``(row_id, parent, child, s, rest)``: products of terms with all their postings."""
    every = terms.join(index.select("parent", "term_id", "postings"), ["parent", "term_id"])
    return every.select("row_id", "parent", "w", "rest", F.inline("postings")).select(
        "row_id", "parent", "child", (F.col("w") * F.col("weight")).alias("s"), "rest")


def frontier_scores(frontier: DataFrame, record_vectors: DataFrame, class_vectors: DataFrame, index: DataFrame,
                    k: int) -> DataFrame:
    """``(row_id, parent, child, p)``: scores of all children that can be among the ``k`` best below a frontier parent and
    share a term with the record; ``frontier``: distinct ``(row_id, parent)``."""
    group = ["row_id", "parent"]
    probe = write_and_read(probe_terms(frontier, record_vectors, index), "beam-probe")
    partial = (_products(probe.filter("strong"), index).groupBy(*group, "child")
               .agg(F.sum("s").alias("partial"), F.max("rest").alias("rest")))
    ranked = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("partial")))
    threshold = F.max(F.when(F.col("rn") == k, F.col("partial"))).over(Window.partitionBy(*group))
    partial = partial.withColumn("rn", ranked).withColumn("least", F.coalesce(threshold, F.lit(0.0))).drop("rn")
    closed = F.col("least") > F.col("rest") + _SLACK
    partial = write_and_read(partial.withColumn("closed", closed)
                             .filter(~F.col("closed") | (F.col("partial") + F.col("rest") >= F.col("least") - _SLACK)), "beam-partial")
    weak = probe.filter(~F.col("strong"))
    # closed: the candidates' own terms; only their products are formed
    own = (partial.filter("closed").select(*group, "child")
           .join(class_vectors.select(F.col("class_idx").alias("child"), "term_id", "weight"), "child")
           .join(weak.select(*group, "term_id", "w"), [*group, "term_id"])
           .select(*group, "child", (F.col("w") * F.col("weight")).alias("s")))
    shut = partial.filter("closed").select(*group).distinct()
    rest = _products(weak.join(shut, group, "left_anti"), index).select(*group, "child", "s")
    all_parts = partial.select(*group, "child", F.col("partial").alias("s")).unionByName(own).unionByName(rest)
    return all_parts.groupBy(*group, "child").agg(F.round(F.sum("s"), DECIMALS).alias("p")).filter("p > 0")


@dataclass
class _Tree:
    """A hierarchy as arrays: children of parent ``i`` are the edges from ``first[i]`` to ``first[i + 1]``, ascending; the entries of
    edge ``j`` those from ``start[j]`` to ``start[j + 1]``."""

    parents: np.ndarray
    first: np.ndarray
    child: np.ndarray
    start: np.ndarray
    term: np.ndarray  # place in terms
    weight: np.ndarray
    terms: np.ndarray

    @staticmethod
    def of(down: pa.Table, entries: pa.Table) -> _Tree:
        """From the distinct edges ``(parent, child)`` and ``(parent, term_id, child, weight)`` below them."""
        parent, child = (c.to_numpy() for c in down.columns)
        order = np.lexsort((child, parent))
        parent, child = parent[order], child[order]
        parents, first = np.unique(parent, return_index=True)
        kids, at = np.unique(child, return_inverse=True)
        above, term, below, weight = (c.to_numpy() for c in entries.columns)
        code = np.searchsorted(parents, parent) * len(kids) + at
        edge = np.searchsorted(code, np.searchsorted(parents, above) * len(kids) + np.searchsorted(kids, below))
        order = np.argsort(edge, kind="stable")
        terms, place = np.unique(term, return_inverse=True)
        return _Tree(parents, np.append(first, len(child)), child, np.searchsorted(edge[order], np.arange(len(child) + 1)),
                     place[order].astype(np.int32), weight[order], terms)


def _small_tree(index: DataFrame, down: DataFrame) -> _Tree | None:
    """The hierarchy as arrays where it has roots and is within :data:`TREE` and :data:`WIDE`."""
    down, index = down.filter("parent IS NOT NULL AND child IS NOT NULL"), index.filter("parent IS NOT NULL AND term_id IS NOT NULL")
    size = (index.select("parent", F.size("postings").alias("n")).unionByName(down.select("parent", F.lit(1).alias("n")))
            .groupBy("parent").agg(F.sum("n").alias("n")))
    total, most, rooted = size.agg(F.sum("n"), F.max("n"), F.max(F.col("parent") == ROOT)).first()
    if not rooted or total > TREE or most > WIDE:
        return None
    parent, term, child = (F.col(c).cast("long").alias(c) for c in ("parent", "term_id", "child"))
    return _Tree.of(down.select(parent, child).toArrow(),
                    index.select("parent", "term_id", F.inline("postings")).select(parent, term, child, F.col("weight").cast("double")).toArrow())


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from ``first[i]`` on, ``n[i]`` of them, one run after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _scores(tree: _Tree, open_: np.ndarray, row: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Scores of pairs (record, edge); ``open_``: a row of weights by place of the term per record."""
    n = tree.start[edge + 1] - tree.start[edge]
    done = np.cumsum(n)
    out = np.empty(len(edge))
    lo = 0
    while lo < len(edge):
        hi = max(lo + 1, np.searchsorted(done, (done[lo - 1] if lo else 0) + _CELLS, "right"))
        some = n[lo:hi]
        at = _runs(tree.start[edge[lo:hi]], some)
        pair = np.repeat(np.arange(hi - lo), some)
        out[lo:hi] = np.bincount(pair, open_[row[lo:hi][pair], tree.term[at]] * tree.weight[at], hi - lo)
        lo = hi
    return np.round(out, DECIMALS)


def _walk(tree: _Tree, open_: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """``(record, triple, child, p)`` of all nodes that the triples visit, each once; None where a way has more nodes than there
    are parents, so that the hierarchy has a cycle. ``widths``: a row per triple."""
    row = np.arange(len(open_))
    node = np.full(len(row), np.searchsorted(tree.parents, ROOT))
    by = np.ones((len(row), len(widths)), bool)  # triples that keep the frontier's rows
    seen: list[tuple[np.ndarray, ...]] = []
    while len(row):
        if len(seen) == len(tree.parents):
            return None
        n = tree.first[node + 1] - tree.first[node]
        of, edge = np.repeat(np.arange(len(node)), n), _runs(tree.first[node], n)
        p = _scores(tree, open_, row[of], edge)
        order = np.lexsort((edge, -p, of))  # stays in runs; edges ascend with the child
        keep = by[of] & (_runs(np.ones_like(n), n)[:, None] <= widths[:, min(len(seen), 2)])
        kept = keep.any(1)
        of, edge, p, keep = of[kept], edge[order][kept], p[order][kept], keep[kept]
        which, triple = np.nonzero(keep)
        seen.append((row[of[which]], triple, tree.child[edge[which]], p[which]))
        # a node below two chosen parents is one row with the triples of both
        below = np.minimum(np.searchsorted(tree.parents, tree.child[edge]), len(tree.parents) - 1)
        inner = tree.parents[below] == tree.child[edge]
        places, place = np.unique(row[of[inner]] * len(tree.parents) + below[inner], return_inverse=True)
        by = np.zeros((len(places), len(widths)), bool)
        np.logical_or.at(by, place, keep[inner])
        row, node = np.divmod(places, len(tree.parents))
    row, triple, child, p = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.lexsort((child, triple, row))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (row, triple, child)], axis=0)
    return tuple(x[order[new]] for x in (row, triple, child, p))


def _walked(records: DataFrame, record_vectors: DataFrame, tree: _Tree, triples: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The whole search of every record in its own row; a null class marks a cycle."""
    sent = records.sparkSession.sparkContext.broadcast(tree)
    widths = np.array(triples, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        names = ["row_id", "k0", "k1", "k2", "class_idx", "p"]
        size = max(1, _CELLS // max(len(tree.terms), len(tree.child)))
        open_ = np.zeros((size, max(1, len(tree.terms))))
        for batch in batches:
            n = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            term, weight = (x.to_numpy(zero_copy_only=False) for x in batch.column(1).flatten().flatten())
            place = np.searchsorted(tree.terms, term)
            for lo in range(0, batch.num_rows, size):
                hi = min(lo + size, batch.num_rows)
                part = slice(ends[lo] - n[lo], ends[hi - 1])
                cells = np.repeat(np.arange(hi - lo), n[lo:hi]) * open_.shape[1] + place[part]
                np.add.at(open_.reshape(-1), cells, weight[part])
                found = _walk(tree, open_[:hi - lo], widths)
                open_.reshape(-1)[cells] = 0.0
                if found is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1), *[pa.nulls(1, pa.int32())] * 3, pa.nulls(1, pa.int64()),
                                                      pa.nulls(1, pa.float64())], names=names)
                    return
                row, triple, child, p = found
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), *(pa.array(widths[triple, i], pa.int32()) for i in range(3)),
                     pa.array(child, pa.int64()), pa.array(p, pa.float64())], names=names)

    per = record_vectors.groupBy("row_id").agg(F.collect_list(F.struct("term_id", "weight")).alias("vector"))
    rows = records.select("row_id").distinct().join(per, "row_id", "left")
    return rows.mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, k0 int, k1 int, k2 int, class_idx long, p double")


def text_beam(records: DataFrame, record_vectors: DataFrame, class_vectors: DataFrame, roots: DataFrame, edges: DataFrame,
              triples: Sequence[tuple[int, int, int]]) -> DataFrame:
    """A7 / A9 with cosines of texts: ``(row_id, k0, k1, k2, class_idx, p)`` for every node visited by each beam triple.

    ``records``: ``row_id``, also of texts without words; vectors: ``(row_id | class_idx, term_id, weight)``, of length one, weights
    not negative; ``roots``: ``node``; ``edges``: ``(parent, child)``; class ids are not :data:`ROOT`. Children that share no
    term score 0; among equal scores the lower class index comes first. A hierarchy with a cycle raises.
    """
    beams = F.array(*[F.struct(F.lit(a).alias("k0"), F.lit(b).alias("k1"), F.lit(c).alias("k2")) for a, b, c in triples])
    down = write_and_read(edges.select("parent", "child").unionByName(
        roots.select(F.lit(ROOT).cast("long").alias("parent"), F.col("node").alias("child"))).distinct(), "beam-down")
    index = write_and_read(inverted_index(class_vectors, down), "beam-index")
    # only terms that some class has add to a score
    record_vectors = record_vectors.join(index.select("term_id").distinct(), "term_id", "left_semi")
    tree = _small_tree(index, down)
    if tree is not None:
        visited = write_and_read(_walked(records, record_vectors, tree, triples), "beam-visited")
        if not visited.filter("class_idx IS NULL").isEmpty():
            raise ValueError("the hierarchy below the roots has a cycle")
        return visited
    frontier = records.select("row_id", F.lit(ROOT).cast("long").alias("parent"), beams.alias("beams")).distinct()
    # written: a constant parent would turn the joins on it into nested loops
    frontier = write_and_read(frontier, "beam-frontier").join(down.select("parent").distinct(), "parent", "left_semi")
    levels: list[DataFrame] = []
    limit = down.count() + 1
    while not frontier.isEmpty():
        width = ("k0", "k1", "k2")[min(len(levels), 2)]
        most = max(t[("k0", "k1", "k2").index(width)] for t in triples)
        chosen = write_and_read(_choose(frontier, record_vectors, class_vectors, index, down, most, width), "beam-level")
        levels.append(chosen)
        if len(levels) > limit:
            raise ValueError("the hierarchy below the roots has a cycle")
        # a node below two chosen parents is one row with the triples of both
        frontier = (chosen.groupBy("row_id", F.col("child").alias("parent"))
                    .agg(F.array_distinct(F.flatten(F.collect_list("beams"))).alias("beams")))
        frontier = frontier.join(down.select("parent").distinct(), "parent", "left_semi")
    if not levels:
        return frontier.select("row_id", F.inline("beams"), F.col("parent").alias("class_idx"), F.lit(0.0).alias("p"))
    visited = levels[0]
    for level in levels[1:]:
        visited = visited.unionByName(level)
    return (visited.select("row_id", F.col("child").alias("class_idx"), "p", F.explode("beams").alias("t"))
            .select("row_id", "t.k0", "t.k1", "t.k2", "class_idx", "p").distinct())


def _choose(frontier: DataFrame, record_vectors: DataFrame, class_vectors: DataFrame, index: DataFrame, down: DataFrame,
            most: int, width: str) -> DataFrame:
    """The ``most`` best children of every frontier parent that some triple keeps: ``(row_id, child, p, beams)``."""
    scored = frontier_scores(frontier.select("row_id", "parent"), record_vectors, class_vectors, index, most)
    order = Window.partitionBy("row_id", "parent").orderBy(F.desc("p"), "child")
    best = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    per = best.groupBy("row_id", "parent").agg(F.array_sort(F.collect_list(F.struct("rn", "child", "p"))).alias("found"))
    # children without a common term fill up from the lowest index: of 2 * most the lists cannot use more
    first = Window.partitionBy("parent").orderBy("child")
    kids = (down.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= 2 * most)
            .groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("kids")))
    out = frontier.join(kids, "parent").join(per, ["row_id", "parent"], "left")
    found = F.coalesce("found", F.array().cast("array<struct<rn:int,child:bigint,p:double>>"))
    left = F.array_except("kids", F.transform(found, lambda x: x["child"]))
    fill: Column = F.transform(left, lambda c, i: F.struct((F.size(found) + i + 1).cast("int").alias("rn"), c.alias("child"),
                                                          F.lit(0.0).alias("p")))
    out = out.select("row_id", "beams", F.inline(F.slice(F.concat(found, fill), 1, most)))
    out = out.withColumn("beams", F.filter("beams", lambda t: t[width] >= F.col("rn")))
    return out.filter(F.size("beams") > 0).select("row_id", "child", "p", "beams")
