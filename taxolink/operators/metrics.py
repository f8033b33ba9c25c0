"""Evaluation.

All metrics are partial + final aggregations over long tables; the beam search
is a loop over hierarchy depth (a handful of rounds) with a per-(record, parent)
top-k that Spark plans as a partial WindowGroupLimit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolink.functions.mathx import argmax2, threshold
from taxolink.session import write_and_read

EPS = 1e-12


def link_cross_entropy(p: Column, label: Column) -> Column:
    """A2 per link: −log p(true class), with p clipped at 1e-12."""
    p_true = F.when(label == 1, p).otherwise(F.lit(1.0) - p)
    return -F.log(F.greatest(p_true, F.lit(EPS)))


def batch_mean_loss(links: DataFrame, batch_col: str = "batch_id", group_cols: Sequence[str] = (),
                    loss: Column | None = None) -> DataFrame:
    """A2: mean cross-entropy per batch (or another per-batch ``loss`` aggregate), then mean over batches:
    ``(group…, n_batches, n_links, loss)``."""
    g = list(group_cols)
    per = links.groupBy(*g, batch_col).agg((F.avg("ce") if loss is None else loss).alias("_l"),
                                           F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*g).agg(F.count(F.lit(1)).alias("n_batches"), F.sum("_n").alias("n_links"),
                               F.avg("_l").alias("loss"))


def class_f1(df: DataFrame, truth: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group and) class present in truth or prediction: ``(group…, _c, f1, support)``.

    One pass counts the (truth, prediction) pairs; each pair then adds to its true class (TP or FN) and its
    predicted class (FP when wrong); per class F1 = 2TP / (2TP + FP + FN), 0 when undefined.
    """
    g = list(group_cols)
    pairs = df.groupBy(*g, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit, zero = F.col("_t") == F.col("_p"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("_t").alias("_c"), F.when(hit, F.col("_n")).otherwise(zero).alias("tp"),
                 F.when(hit, zero).otherwise(F.col("_n")).alias("fn"), zero.alias("fp")),
        F.struct(F.col("_p").alias("_c"), zero.alias("tp"), zero.alias("fn"),
                 F.when(hit, zero).otherwise(F.col("_n")).alias("fp")))
    per = (pairs.select(*g, F.inline(sides)).groupBy(*g, "_c")
           .agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp")))
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return per.select(*g, "_c", F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(F.lit(0.0)).alias("f1"),
                      (F.col("tp") + F.col("fn")).alias("support"))


def macro_f1(df: DataFrame, truth: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """A3: macro-F1 over the classes present in truth or prediction (per group); 0 when undefined."""
    return class_f1(df, truth, pred, group_cols).groupBy(*group_cols).agg(F.avg("f1").alias("macro_f1"))


def batch_weighted_f1(df: DataFrame, truth: str, pred: str, batch_col: str = "batch_id",
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """A4: Σ(batch macro-F1 × batch links) / Σ links (not the global macro-F1), per group."""
    g = list(group_cols)
    per = class_f1(df, truth, pred, [*g, batch_col]).groupBy(*g, batch_col).agg(
        F.avg("f1").alias("macro_f1"), F.sum("support").alias("_n"))
    return per.groupBy(*g).agg(F.count(F.lit(1)).alias("n_batches"),
                               (F.sum(F.col("macro_f1") * F.col("_n")) / F.sum("_n")).alias("epoch_f1"))


def predicted_class(p0: Column, p1: Column) -> Column:
    """arg-max with ties to class 0."""
    return argmax2(p0, p1)


def threshold_accuracy(df: DataFrame, p: str, label: str, th: float = 0.5) -> DataFrame:
    """A5: share of links where (p ≥ th) equals the label."""
    return df.agg(F.avg((threshold(F.col(p), th) == F.col(label)).cast("double")).alias("th_acc"))


def threshold_f1(df: DataFrame, p: str, label: str, th: float = 0.5) -> DataFrame:
    """Macro-F1 of the thresholded prediction (p of class 1 ≥ th)."""
    return macro_f1(df.withColumn("_thp", threshold(F.col(p), th)), label, "_thp").withColumnRenamed("macro_f1", "th_f1")


# ---------------------------------------------------------------- hierarchical beam

Scorer = Callable[[DataFrame], DataFrame]


def table_scorer(scores: DataFrame, id_col: str = "row_id") -> Scorer:
    """Look scores up in a precomputed ``(id, class_idx, p)`` table."""
    def score(frontier: DataFrame) -> DataFrame:
        return frontier.join(scores.select(id_col, "class_idx", "p"), [id_col, "class_idx"])
    return score


def beam_search(records: DataFrame, roots: DataFrame, edges: DataFrame, scorer: Scorer,
                triples: Sequence[tuple[int, int, int]], id_col: str = "row_id") -> DataFrame:
    """Visited nodes ``(id, k0, k1, k2, class_idx)`` for each beam triple.

    Level 0: top k0 roots by score; level 1: top k1 children of each chosen root; deeper
    levels: top k2 children of each node chosen on the level above, until a level is empty.
    Only frontier pairs are scored, each once for all triples: a node's children rank the same for every triple
    that chose it, so a row carries the list of triples that keep it. Ties go to the lower class
    index. ``edges`` is the parent → child table ``(parent, child)``.

    Each level's choice is written once to the shared scratch folder, so later levels and the final union read
    it instead of re-deriving every level above. A hierarchy with a cycle raises.
    """
    beams = F.array(*[F.struct(F.lit(a).alias("k0"), F.lit(b).alias("k1"), F.lit(c).alias("k2")) for a, b, c in triples])

    def choose(scored: DataFrame, part: Sequence[str], kept: Column, width: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(F.col("p").desc(), F.col("class_idx").asc())
        most = max(t[("k0", "k1", "k2").index(width)] for t in triples)
        ranked = scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
        ranked = ranked.withColumn("_beams", F.filter(kept, lambda t: t[width] >= F.col("_rn"))).filter(F.size("_beams") > 0)
        # a node below two chosen parents is one row with the triples of both
        return write_and_read(ranked.groupBy(id_col, "class_idx").agg(
            F.array_distinct(F.flatten(F.collect_list("_beams"))).alias("_beams")), "beam")

    root_ids = roots.agg(F.sort_array(F.collect_set("node")).alias("ids")).scalar()
    pairs = records.select(id_col, root_ids.alias("_roots")).select(id_col, F.explode("_roots").alias("class_idx"))
    chosen = choose(scorer(pairs), [id_col], beams, "k0")
    levels = [chosen]
    limit = edges.count() + 1
    while not levels[-1].isEmpty():
        if len(levels) > limit:
            raise ValueError("the hierarchy below the roots has a cycle")
        below = (levels[-1].join(edges.select("parent", "child"), F.col("class_idx") == F.col("parent"))
                 .select(id_col, "parent", F.col("child").alias("class_idx"), "_beams"))
        levels.append(choose(scorer(below), [id_col, "parent"], F.col("_beams"), "k1" if len(levels) == 1 else "k2"))
    visited = levels[0]
    for level in levels[1:]:
        visited = visited.unionByName(level)
    return (visited.select(id_col, "class_idx", F.explode("_beams").alias("_t"))
            .select(id_col, "_t.k0", "_t.k1", "_t.k2", "class_idx").distinct())


def topk_accuracy(visited: DataFrame, true_labels: DataFrame, records: DataFrame, id_col: str = "row_id") -> DataFrame:
    """A record is right if any visited node is one of its original labels; mean over all
    ``records``, visited or not, per beam triple: ``(k0, k1, k2, accuracy)``."""
    keys = [id_col, "k0", "k1", "k2"]
    n = records.select(id_col).distinct().count()
    truth = true_labels.select(F.col(id_col).alias("_id"), F.col("class_idx").alias("_class")).distinct()
    hit = visited.join(truth, (F.col(id_col) == F.col("_id")) & (F.col("class_idx") == F.col("_class")), "left")
    per = hit.groupBy(*keys).agg(F.max(F.col("_class").isNotNull().cast("int")).alias("_hit"))
    return per.groupBy("k0", "k1", "k2").agg((F.sum("_hit") / F.lit(max(n, 1))).alias("accuracy"))


# ---------------------------------------------------------------- epoch history

def running_best(history: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch",
                 acc_col: str = "val_acc") -> DataFrame:
    """An epoch is saved if its accuracy is strictly above the best before it (start -1)."""
    w = Window.partitionBy(run_col).orderBy(epoch_col).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.max(acc_col).over(w), F.lit(-1.0))
    return history.withColumn("best_before", prev).withColumn("saved", (F.col(acc_col) > prev).cast("int"))


def epoch_history(history: DataFrame, value_col: str, run_col: str = "run_id",
                  epoch_col: str = "epoch") -> DataFrame:
    """Per run the values in epoch order (one entry per epoch)."""
    return history.groupBy(run_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(epoch_col, value_col))),
                    lambda s: s[value_col]).alias("values"))


def best_epoch(history: DataFrame, loss_col: str = "loss", run_col: str = "run_id",
               epoch_col: str = "epoch") -> DataFrame:
    """The epoch with the lowest loss per run (earliest on ties)."""
    m = F.min(F.struct(F.col(loss_col), F.col(epoch_col)))
    return history.groupBy(run_col).agg(m.alias("_m")).select(
        run_col, F.col(f"_m.{epoch_col}").alias("best_epoch"), F.col(f"_m.{loss_col}").alias("best_loss"))
