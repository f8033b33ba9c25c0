"""Driver queries of text-driven search, trained heads, window tables, epochs and member sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.operators import head_training as HT
from taxolink.operators import labels as L
from taxolink.operators import metrics as M
from taxolink.operators import scoring as SC
from taxolink.operators import splits as SP
from taxolink.operators import taxonomy as H
from taxolink.operators import textbeam as TB
from taxolink.operators import variants as V
from taxolink.operators import windows as WN
from taxolink.plans import standins as S
from taxolink.plans.queries import _emb_links, _random_masks, append_classes, query
from taxolink.session import scratch_path, table_path, write_and_read
from taxolink.sources import bundle as BD


@query("text_beam")
def text_beam(spark: SparkSession, d: str) -> DataFrame:
    """M6 → A7, A9: documents searched down the tree of benchmark items by TF-IDF cosines of frontier pairs."""
    docs, items = S.read(spark, d, "documents"), S.read(spark, d, "benchmark")
    corpus = docs.select(F.lit("record").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        items.select(F.lit("class").alias("kind"), F.col("item_id").alias("id"), "text"))
    # terms that no item has add nothing to a score; they count in the norms
    vectors = write_and_read(SC.text_vectors(corpus, ["kind", "id"], among=F.col("kind") == "class"), "beam-vectors")
    of = vectors.filter("kind = 'record'").select(F.col("id").alias("row_id"), "term_id", "weight")
    cls = vectors.filter("kind = 'class'").select(F.col("id").alias("class_idx"), "term_id", "weight")
    tree = items.select(F.col("item_id").alias("node"), S.item_parent(F.col("item_id")).alias("parent"))
    out = TB.text_beam(docs.select(F.col("doc_id").alias("row_id")), of, cls, tree.filter("parent = -1").select("node"),
                       tree.filter("parent <> -1").select("parent", F.col("node").alias("child")), S.BEAM_TRIPLES)
    return out.withColumn("p", F.round("p", 6))


@query("trained_head")
def trained_head(spark: SparkSession, d: str) -> DataFrame:
    """The two-layer head trained on training links; losses and macro-F1 per epoch, saved epochs, the best
    epoch by validation loss, and that head on the test links."""
    scaled = _emb_links(spark, d).withColumns({c: F.transform(c, lambda x: x * S.HEAD_SCALE) for c in ("rvec", "cvec")})
    links = write_and_read(HT.with_features(scaled).select("row_id", "slot", "label", "features"), "head-links")
    masks = write_and_read(_random_masks(spark, d), "masks")

    def part(name: str) -> DataFrame:
        return links.join(masks.filter(f"is_{name}").select("row_id"), "row_id", "left_semi")

    path = scratch_path(spark, "head-weights")
    history, _ = HT.train_head(part("train"), part("val"), path, S.HEAD_HIDDEN, S.HEAD_EPOCHS, S.HEAD_STEPS, S.HEAD_RATE,
                               ["row_id", "slot"], S.SEED)
    best = M.best_epoch(history, "val_loss").first()
    loss, f1 = HT.evaluate(part("test"), HT.load_head(spark, path, best["best_epoch"]))
    saved = M.running_best(history).withColumn("saved", F.col("saved").cast("double"))
    per = saved.unpivot(["epoch"], ["train_loss", "val_loss", "val_acc", "saved"], "metric", "value")
    test = spark.createDataFrame([(best["best_epoch"], "test_loss", loss), (best["best_epoch"], "test_f1", f1)],
                                 "epoch long, metric string, value double")
    return per.unionByName(test).withColumn("value", F.round("value", 5))


@query("window_match")
def window_match(spark: SparkSession, d: str) -> DataFrame:
    """J5 with windows as a table: the window of first priority that holds an order's date."""
    cust = S.read(spark, d, "customer").select("c_custkey")
    return WN.first_window(S.records(spark, d).select("row_id", "ts"), S.date_windows(cust))


@query("epoch_batches")
def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    """Place and batch of every order in each epoch."""
    return SP.epoch_batches(S.records(spark, d), "row_id", S.BATCH_SIZE, S.HEAD_EPOCHS, S.SEED)


@query("class_overlap")
def class_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap, union and difference of the member sets of all pairs of classes."""
    return L.class_overlap(write_and_read(L.member_words(S.labels(spark, d)), "member-words"))


@query("path_ladder")
def path_ladder(spark: SparkSession, d: str) -> DataFrame:
    """H4 with more paths than a BIGINT holds: exact counts as text, and their binary exponent."""
    paths = H.depth_paths(write_and_read(S.ladder_parents(S.read(spark, d, "part").select("p_size", "p_brand", "p_type")), "ladder"))
    return paths.select("node", "depth", F.col("n_paths").cast("string").alias("n_paths"), "exponent")


@query("dag_ancestors")
def dag_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Ancestor closure of the part → brand, type → size band DAG: two parents, shared ancestors."""
    return H.ancestors(S.dag_parents(spark, d))


@query("variant_bundle")
def variant_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The random variant with masks, labels and hierarchy, written as one unit and loaded again; every
    row of every part as ``(part, a, b, c, text)``."""
    def build() -> dict[str, DataFrame]:
        named = write_and_read(append_classes(spark, d), "variant-rows")
        recs = S.records(spark, d).select("row_id", "ts").join(named.filter("not is_class").select("row_id", "text"), "row_id")
        crow = named.filter("is_class").select("row_id", "text")
        return V.variant_bundle("random", recs, S.labels(spark, d), S.classes(spark, d), crow, S.dag_parents(spark, d),
                                S.TEMPORAL_WINDOWS, seed=S.SEED, train_frac=S.TRAIN_FRAC, val_frac=S.VAL_FRAC)

    def never() -> dict[str, DataFrame]:
        raise AssertionError("the finished bundle must be loaded, not built again")

    root, inputs = scratch_path(spark, "variant"), [table_path(d, t) for t in ("orders", "lineitem", "part")]
    BD.materialize_unit(spark, root, build, inputs, {"variant": "random"})
    parts = BD.materialize_unit(spark, root, never, inputs, {"variant": "random"})
    mask = F.when(F.col("is_train"), 1).otherwise(0) + F.when(F.col("is_val"), 2).otherwise(0) + F.when(F.col("is_test"), 4).otherwise(0)
    shown = {"rows": ("row_id", mask, F.col("is_class").cast("int"), "text"),
             "labels": ("row_id", "class_idx", F.lit(0), "row_kind"),
             "classes": ("class_idx", F.lit(0), F.lit(0), "class_name"),
             "edges": ("child", "parent", "pos", F.lit("")),
             "edges_indexed": ("src", "dst", "pos", "form"),
             "depths": ("node", "depth", "n_paths", F.lit("")),
             "levels": ("node", "depth", F.lit(0), F.lit("")),
             "ancestors": ("node", "ancestor", F.lit(0), F.lit(""))}
    out = None
    for name, cols in shown.items():
        a, b, c, text = (F.col(x) if isinstance(x, str) else x for x in cols)
        one = parts[name].select(F.lit(name).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"),
                                 c.cast("long").alias("c"), text.alias("text"))
        out = one if out is None else out.unionByName(one)
    return out
