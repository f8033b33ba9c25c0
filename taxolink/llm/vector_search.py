"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample on the driver (:data:`SAMPLE` vectors; each node splits into
:data:`BRANCH` children by spherical k-means until a leaf is small) and sent to all executors; every vector is then
indexed by descending to a leaf. A query walks the tree with a priority queue of unopened nodes, nearest
center first, and so meets leaves in the order of their promise. How many leaves a query visits is calibrated:
for :data:`PROBES` queries the exact neighbours among all vectors are found by blocked products, and the number of
visits is widened until the leaves visited hold the wanted share of them. A query goes on beyond that number while its
leaves hold no more than k classes.

Equal vectors are one class with its smallest ids, so a vector that a third of the rows share is compared once.
Neighbouring leaves are stored together in buckets of about :data:`BLOCK` classes (a larger leaf in several blocks). A query goes
to a bucket once, with the list of its leaves there; a task sorts one block by leaf, compares each leaf's slice with
the queries that visit that leaf, and returns the best few per query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another length than most, nor rows with a null id; queries without candidates have no rows; repeated rows are candidates of
their own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolink.llm.vectors import common_width, cosine, matrix, sample, spherical_kmeans, unit, usable
from taxolink.session import write_and_read

SAMPLE, BRANCH, LEAF_ROWS, BLOCK, PROBES = 32768, 8, 256, 4096, 256


class Tree:
    """Centers of all nodes; ``children[i]`` lists node i's children, and leaves are nodes without."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branch: int = BRANCH):
        self.centers = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])]
        self.children: list[list[int]] = [[]]
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            centers = spherical_kmeans(rows, branch, seed=node)
            home = np.argmax(rows @ centers.T, axis=1)
            kept = np.unique(home)
            if len(kept) < 2:
                continue
            for k in kept:
                self.children[node].append(len(self.centers))
                todo.append((len(self.centers), rows[home == k]))
                self.centers.append(centers[k])
                self.children.append([])
        self.centers = np.array(self.centers)
        self.n_leaves = sum(not c for c in self.children)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf each unit row descends to."""
        at = np.zeros(len(x), np.int64)
        level = [0]
        while level:
            deeper = []
            for node in level:
                kids = self.children[node]
                if kids:
                    rows = np.flatnonzero(at == node)
                    if len(rows):
                        at[rows] = np.array(kids)[np.argmax(x[rows] @ self.centers[kids].T, axis=1)]
                    deeper += kids
            level = deeper
        return at

    def visits(self, q: np.ndarray, most: int, members: dict[int, int] | None = None, enough: int = 0) -> Iterator[list[int]]:
        """Per unit row, the first ``most`` leaves in best-bin-first order; with ``members`` (classes per leaf that holds any)
        these leaves only, and more of them until they hold ``enough``."""
        nearness = q @ self.centers.T
        for row in nearness:
            queue, out, held = [(0.0, 0)], [], 0
            while queue and (len(out) < most or held < enough):
                _, node = heapq.heappop(queue)
                kids = self.children[node]
                if kids:
                    for k in kids:
                        heapq.heappush(queue, (-row[k], k))
                elif members is None:
                    out.append(node)
                elif node in members:
                    out.append(node)
                    held += members[node]
            yield out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's entries that may be among its k best, ties included."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    return scores >= floor[:, None] - 1e-12


def _exact(spark, classes: DataFrame, probes: np.ndarray, k: int, width: int) -> DataFrame:
    """``(probe, vector, score)``: the k + 1 nearest classes of every probe among all classes."""
    sent = spark.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = matrix(part.column(0), width)
                scores = sent.value @ unit(x).T
                q, i = np.nonzero(_best(scores, k + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.astype(np.int32)), part.column(0).take(pa.array(i)), pa.array(scores[q, i])],
                    names=["probe", "vector", "score"])

    near = classes.select("vector").mapInArrow(run, "probe int, vector array<float>, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vector")
    return near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)


def calibrate(spark, tree: Tree, classes: DataFrame, queries: DataFrame, k: int, width: int,
              recall: float) -> int:
    """Fewest leaf visits that reach ``recall`` of the probes' exact neighbours."""
    probes = unit(sample(queries, "vector", "id", PROBES, width))
    near = _exact(spark, classes, probes, k, width).select("probe", "vector").toArrow()  # PROBES * (k + 1) rows
    if not near.num_rows:
        return 1
    leaf = tree.leaves(unit(matrix(near.column("vector").combine_chunks(), width)))
    order = list(tree.visits(probes, tree.n_leaves))
    at = sorted(order[q].index(x) + 1 for q, x in zip(near.column("probe").to_pylist(), leaf.tolist()))
    return at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]


def nearest(rows: DataFrame, is_query: Column, k: int = 5, recall: float = 0.98, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the k nearest rows found for every query row, itself left out."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"),
                       F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("vector")) & F.col("id").isNotNull())
    width = common_width(rows, "vector")
    rows = rows.filter(F.size("vector") == width)
    # classes of equal vectors with their k + 1 smallest ids (a query may be one of them)
    first = Window.partitionBy("vector").orderBy("id")
    classes = write_and_read(
        rows.select("id", "vector").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
        .groupBy("vector").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "ann-classes")
    asking = write_and_read(rows.filter("asks").select("id", "vector"), "ann-queries")
    queries = write_and_read(asking.groupBy("vector").agg(F.min("id").alias("id")), "ann-query-classes")

    n = classes.count()
    some = sample(classes, "vector", "id", SAMPLE, width)
    some = unit(some) if len(some) else some
    tree = Tree(some, max(8, LEAF_ROWS * len(some) // max(n, 1)))
    visits = calibrate(spark, tree, classes, queries, k, width, recall)
    sent = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = sent.value.leaves(unit(matrix(batch.column(0), width)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))],
                                                 names=["vector", "id", "ids", "leaf"])

    indexed = write_and_read(classes.select("vector", "id", "ids").mapInArrow(
        index, "vector array<float>, id long, ids array<bigint>, leaf int"), "ann-index")
    # leaves in tree order fill buckets of about BLOCK classes; a larger leaf is a bucket of several blocks. The tree
    # bounds the number of leaves, and so these tables.
    members = {r["leaf"]: r["members"] for r in
               indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")).orderBy("leaf").collect()}
    bucket_of, bucket, held = {}, 0, 0
    for leaf, count in members.items():
        if held and held + count > BLOCK:
            bucket, held = bucket + 1, 0
        held += count
        bucket_of[leaf] = bucket
    stored = spark.sparkContext.broadcast((members, bucket_of))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, bucket_of = stored.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, opened, lists = [], [], []
                for i, found in enumerate(sent.value.visits(unit(matrix(part.column(0), width)), visits, members, k + 1)):
                    here: dict[int, list[int]] = {}
                    for leaf in found:
                        here.setdefault(bucket_of[leaf], []).append(leaf)
                    row += [i] * len(here)
                    opened += here.keys()
                    lists += here.values()
                yield pa.RecordBatch.from_arrays(
                    [*part.take(pa.array(row, pa.int64())).columns, pa.array(opened, pa.int32()),
                     pa.array(lists, pa.list_(pa.int32()))], names=["vector", "id", "bucket", "leaves"])

    asked = write_and_read(queries.select("vector", "id").mapInArrow(
        ask, "vector array<float>, id long, bucket int, leaves array<int>"), "ann-asked")
    buckets = F.broadcast(spark.createDataFrame(list(bucket_of.items()), "leaf int, bucket int"))
    indexed = indexed.join(buckets, "leaf")
    blocks = F.broadcast(write_and_read(
        indexed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "ann-blocks"))
    # queries of a bucket in parts, so that no task meets all queries of a popular one
    parts = F.broadcast(write_and_read(
        asked.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "ann-parts"))
    homes = (indexed.join(blocks, "bucket").join(parts, "bucket")
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select("bucket", "block", "part", "id", "vector", "ids", F.array("leaf").alias("leaves")))
    asked = (asked.join(blocks, "bucket").join(parts, "bucket")
             .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("bucket", "block", "part", "id", "vector", F.lit(None).cast("array<bigint>").alias("ids"), "leaves"))
    found = homes.unionByName(asked).groupBy("bucket", "block", "part").applyInArrow(
        _compare(k, width), "query long, id long, score double")
    best = (found.withColumn("nth", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= k + 1))
    lists = write_and_read(
        best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))
        .join(queries.select(F.col("id").alias("query"), F.col("vector").alias("v")), "query").select("v", "found"), "ann-found")
    own = asking.join(lists, F.col("vector") == F.col("v"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return (own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "hit"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit")["id"].alias("id"),
                    F.col("hit")["score"].alias("score")))


def _compare(k: int, width: int):
    """Best k + 1 ids per query of a block among the leaves it visits, by cosine on the original vectors, ties to smaller ids."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("ids").is_null().to_numpy()
        homes, asking = (table.filter(pa.array(m)).combine_chunks() for m in (~asks, asks))
        if not homes.num_rows or not asking.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        leaf = homes.column("leaves").chunk(0).flatten().to_numpy()
        by_leaf = np.argsort(leaf, kind="stable")
        leaf, homes = leaf[by_leaf], homes.take(pa.array(by_leaf)).combine_chunks()
        x, q = matrix(homes.column("vector").chunk(0), width), matrix(asking.column("vector").chunk(0), width)
        ids, names = homes.column("ids").to_pylist(), asking.column("id").to_numpy()
        ux, uq = unit(x), unit(q)
        lists = asking.column("leaves").chunk(0)
        wants = lists.flatten().to_numpy()
        by_want = np.argsort(wants, kind="stable")
        who = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())[by_want]
        wants = wants[by_want]
        rows, cols = [np.array([], np.int64)], [np.array([], np.int64)]
        for one in np.unique(leaf):
            lo, hi = np.searchsorted(leaf, [one, one + 1])
            visitors = who[slice(*np.searchsorted(wants, [one, one + 1]))]
            for at in range(0, len(visitors), 512):
                some = visitors[at:at + 512]
                i, j = np.nonzero(_best(uq[some] @ ux[lo:hi].T, k + 1))
                rows.append(some[i])
                cols.append(lo + j)
        row, col = np.concatenate(rows), np.concatenate(cols)
        in_order = np.argsort(row, kind="stable")
        row, col = row[in_order], col[in_order]
        score = cosine(q[row], x[col])
        out_q, out_id, out_s = [], [], []
        for r, (a, b) in enumerate(zip(np.searchsorted(row, np.arange(len(q))), np.searchsorted(row, np.arange(len(q)), "right"))):
            hits = sorted((-score[i], v) for i in range(a, b) for v in ids[col[i]])[:k + 1]
            out_q += [int(names[r])] * len(hits)
            out_id += [v for _, v in hits]
            out_s += [-s for s, _ in hits]
        return pa.table({"query": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()),
                         "score": pa.array(out_s, pa.float64())})
    return run
