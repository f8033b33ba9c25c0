"""The two-layer pair head (M5) trained by distributed gradient steps.

The head is ``softmax(W2 tanh(W1 f + b1) + b2)`` on pair features f (M1). In every step each task sums the gradient over its links
of the step's batch; the sums are added up in two levels and in a fixed order, so a rerun gives the same weights. Only one sum
of the head's size per :data:`FAN` reaches the driver, which moves the weights. Weights are kept as a versioned table, one
version per epoch, that scoring (M2) reads; the loss of every step is kept too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.functions.keys import hash_u32, order_key
from taxolink.functions.mathx import argmax2
from taxolink.operators import metrics as M
from taxolink.operators.scoring import pair_features
from taxolink.session import write_and_read

#: Partial sums that reach the driver in a step, at most; links a task handles at a time.
FAN, STRIP = 16, 4096
_PARTS = "part int, n long, loss double, gradient array<double>"


@dataclass(frozen=True)
class Head:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.w1, self.b1, self.w2, self.b2)])

    def moved(self, step: np.ndarray) -> Head:
        """The head with ``step`` (flat) added to its weights."""
        out, at = [], 0
        for a in (self.w1, self.b1, self.w2, self.b2):
            out.append(a + step[at:at + a.size].reshape(a.shape))
            at += a.size
        return Head(*out)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1.T + self.b1) @ self.w2.T + self.b2

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over rows of the cross-entropy (p clipped at 1e-12 as in A2) and of its gradient, flat."""
        h = np.tanh(x @ self.w1.T + self.b1)
        z = h @ self.w2.T + self.b2
        p1 = 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))
        loss = float(-np.log(np.maximum(np.where(y == 1, p1, 1.0 - p1), 1e-12)).sum())
        dz = np.stack([y - p1, p1 - y], axis=1)
        dh = (dz @ self.w2) * (1.0 - h * h)
        return loss, np.concatenate([(dh.T @ x).ravel(), dh.sum(axis=0), (dz.T @ h).ravel(), dz.sum(axis=0)])


def initial_head(features: int, hidden: int) -> Head:
    """Start weights by rule: W1[i, j] = 0.05 sin(1 + features i + j), W2[c, i] = 0.1 sin(7 + hidden c + i), biases 0."""
    i, j, c = np.arange(hidden)[:, None], np.arange(features)[None, :], np.arange(2)[:, None]
    return Head(0.05 * np.sin(1 + features * i + j), np.zeros(hidden), 0.1 * np.sin(7 + hidden * c + np.arange(hidden)[None, :]),
                np.zeros(2))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def gradient_sums(links: DataFrame, head: Head) -> tuple[int, float, np.ndarray]:
    """``(links, sum of losses, sum of gradients)`` over ``(features, label)`` rows."""
    size = len(head.flat())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total, part = 0, 0.0, np.zeros(size), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIP):
                rows = batch.slice(lo, STRIP)
                part = rows.column(2)[0].as_py()
                more, gradient = head.gradient(_matrix(rows.column(0)), rows.column(1).to_numpy(zero_copy_only=False))
                n, loss, total = n + rows.num_rows, loss + more, total + gradient
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([total.tolist()])],
                                             names=["part", "n", "loss", "gradient"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.zeros(size)
        for row in table.column("gradient"):
            total += np.asarray(row.values)
        return pa.table({"part": pa.array([min(table.column("part").to_pylist())], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "loss": [sum(table.column("loss").to_pylist())], "gradient": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = links.select("features", F.col("label").cast("double"), F.spark_partition_id().alias("part")).mapInArrow(partial, _PARTS)
    sums = parts.groupBy(F.pmod("part", F.lit(FAN)).alias("fan")).applyInArrow(added, _PARTS).collect()
    total = np.zeros(size)
    for r in sorted(sums, key=lambda r: r["part"]):
        total += np.array(r["gradient"])
    return sum(r["n"] for r in sums), sum(r["loss"] for r in sums), total


def save_head(spark: SparkSession, head: Head, path: str, version: int) -> None:
    """Append a version to the weight table ``(version, layer, i, j, value)``."""
    rows = [(layer, int(i), int(j), float(a[i, j])) for layer, a in zip(
        ("w1", "b1", "w2", "b2"), (head.w1, head.b1[None, :], head.w2, head.b2[None, :])) for i, j in np.ndindex(a.shape)]
    spark.createDataFrame(rows, "layer string, i int, j int, value double").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/version={version}")


def load_head(spark: SparkSession, path: str, version: int) -> Head:
    """A version of the weight table; the driver gets the head's numbers."""
    found = {}
    for r in spark.read.parquet(f"{path}/version={version}").collect():
        found.setdefault(r["layer"], {})[r["i"], r["j"]] = r["value"]
    out = {}
    for layer, cells in found.items():
        out[layer] = np.zeros((max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1))
        for at, value in cells.items():
            out[layer][at] = value
    return Head(out["w1"], out["b1"][0], out["w2"], out["b2"][0])


def with_features(links: DataFrame) -> DataFrame:
    """Gathered links with their pair features in place of the vectors (M1)."""
    return links.withColumn("features", pair_features()).drop("rvec", "cvec")


def step_of(keys: list[str], steps: int, seed: int) -> Column:
    """Batch of a link in an epoch: a seeded draw, so that a batch needs no sort."""
    return (hash_u32(seed, F.lit("step"), *keys) % F.lit(steps)).cast("int")


def score_with_head(links: DataFrame, head: Head) -> DataFrame:
    """M2, M3 with fitted weights: adds ``p`` to links with ``features``; Arrow batches, one matrix product each."""
    names = [f.name for f in links.schema.fields if f.name not in ("features", "p")]
    schema = ", ".join([*(f"`{n}` {links.schema[n].dataType.simpleString()}" for n in names), "p double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = head.logits(_matrix(batch.column(len(names))))
                p = 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*names, "p"])

    return links.select(*names, "features").mapInArrow(run, schema)


def evaluate(links: DataFrame, head: Head) -> tuple[float, float]:
    """``(mean cross-entropy, macro-F1 of the arg-max class)`` of a head on links (A2, A3); zeros without links."""
    scored = score_with_head(links, head).select(
        "label", M.link_cross_entropy(F.col("p"), F.col("label")).alias("ce"), argmax2(1.0 - F.col("p"), F.col("p")).alias("pred"))
    pairs = scored.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("ce").alias("ce")).collect()  # four rows
    total = sum(r["n"] for r in pairs)
    f1 = []
    for c in {r["label"] for r in pairs} | {r["pred"] for r in pairs}:
        hit = sum(r["n"] for r in pairs if r["label"] == c == r["pred"])
        of = sum(r["n"] * ((r["label"] == c) + (r["pred"] == c)) for r in pairs)
        f1.append(2.0 * hit / of if of else 0.0)
    return (sum(r["ce"] for r in pairs) / total, sum(f1) / len(f1)) if total else (0.0, 0.0)


def train_head(train: DataFrame, val: DataFrame, path: str, hidden: int, epochs: int, steps: int, rate: float,
               keys: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train on links ``(keys…, features, label)``: ``(history, steps)``.

    ``history``: ``(run_id, epoch, train_loss, val_loss, val_acc)``, what A11 to A13 read; version e of the weight table at ``path`` is
    the head after epoch e. ``steps``: ``(run_id, epoch, step, n_links, loss)``, the mean loss before each step. A step reads its
    own batch of the written training table only. Empty batches are passed over.
    """
    spark = train.sparkSession
    width = train.select(F.size("features").alias("n")).first()
    if width is None:
        raise ValueError("no links to train on")
    batches = train.select(*keys, "features", "label", step_of(keys, steps, seed).alias("step"))
    # sorted by step: the files' statistics let a step read its own links only
    folder = write_and_read(batches.sort("step", order_key(seed, *keys)), "head-batches")
    head, history, log = initial_head(width["n"], hidden), [], []
    for epoch in range(epochs):
        loss = n = 0
        for step in range(steps):
            count, total, gradient = gradient_sums(folder.filter(F.col("step") == step), head)
            if not count:
                continue
            log.append(("head", epoch, step, count, total / count))
            loss, n = loss + total, n + count
            head = head.moved(-rate / count * gradient)
        save_head(spark, head, path, epoch)
        val_loss, val_f1 = evaluate(val, head)
        history.append(("head", epoch, loss / n, val_loss, val_f1))
    return (spark.createDataFrame(history, "run_id string, epoch long, train_loss double, val_loss double, val_acc double"),
            spark.createDataFrame(log, "run_id string, epoch long, step long, n_links long, loss double"))
