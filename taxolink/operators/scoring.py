"""Link scoring.

Vectors are ``array<double>`` columns. Class vectors (one per class) and record vectors are joined by
key; text vectors are long tables.
The pair head (linear 2d→d, tanh, linear d→2, softmax) runs as an Arrow-batched
pandas UDF: one NumPy matrix product per batch instead of per-row Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolink.functions.arrays import abs_diff_and_product
from taxolink.functions.mathx import softmax2_p1
from taxolink.operators.ranking import HASH_BYTES, exact_row_number, range_count
from taxolink.operators.textprep import HEAD_CHARS, HEAD_WORDS, RESERVED, words
from taxolink.session import write_and_read


def class_vectors(vectors: DataFrame, label_col: str, vec_col: str, dim: int) -> DataFrame:
    """Per-class mean vector (class centroid): ``(class_idx, cvec)``. Partial + final averages per component, so a
    class holding most rows is still averaged by many tasks."""
    means = [F.avg(F.get(F.col(vec_col), i).cast("double")).alias(f"_m{i}") for i in range(dim)]
    per = vectors.groupBy(F.col(label_col).alias("class_idx")).agg(*means)
    return per.select("class_idx", F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("cvec"))


def gather(links: DataFrame, rec_vectors: DataFrame, cls_vectors: DataFrame,
           id_col: str = "row_id") -> DataFrame:
    """Attach the record vector and the class vector to every link (Spark picks the joins from the sides' sizes)."""
    return (links.join(rec_vectors.select(id_col, "rvec"), id_col)
                 .join(cls_vectors.select("class_idx", "cvec"), "class_idx"))


def pair_features(a: str = "rvec", b: str = "cvec") -> Column:
    """M1: ``[|a-b| ; a*b]``."""
    return abs_diff_and_product(F.col(a), F.col(b))


def head_weights(d: int):
    """Fixed head weights by rule (the trained network is not part of this engine):
    W1[i, j] = 0.05·sin(1 + 2d·i + j), b1[i] = 0.01·cos(i), W2[c, i] = 0.1·sin(7 + d·c + i), b2 = 0."""
    i = np.arange(d)[:, None]
    j = np.arange(2 * d)[None, :]
    w1 = 0.05 * np.sin(1 + 2 * d * i + j)
    b1 = 0.01 * np.cos(np.arange(d))
    c = np.arange(2)[:, None]
    w2 = 0.1 * np.sin(7 + d * c + np.arange(d)[None, :])
    b2 = np.zeros(2)
    return w1, b1, w2, b2


def head_logits(features: Column, d: int) -> Column:
    """M2: logits of the pair head, computed per Arrow batch with NumPy."""
    w1, b1, w2, b2 = head_weights(d)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _head(feat: pd.Series) -> pd.Series:
        if len(feat) == 0:
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in feat])
        h = np.tanh(x @ w1.T + b1)
        lg = h @ w2.T + b2
        return pd.Series(list(lg))

    return _head(features)


def link_probability(logits: Column) -> Column:
    """M3: softmax over the two logits, class 1."""
    return softmax2_p1(F.get(logits, 0), F.get(logits, 1))


def score_links(links: DataFrame, d: int) -> DataFrame:
    """M1–M3 on gathered links: adds ``p`` (probability of a true link)."""
    lg = head_logits(pair_features(), d)
    return links.withColumn("_lg", lg).withColumn("p", link_probability(F.col("_lg"))).drop("_lg")


def score_matrix(scores: DataFrame, id_col: str = "row_id") -> DataFrame:
    """M4: per record a map class → probability (at most #classes entries)."""
    return scores.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("class_idx", "p"))).alias("scores"))


def total_loss(link_ce: Column, text_loss: Column | None = None, lam: float = 0.1) -> Column:
    """M8: mean link cross-entropy + λ · mean text loss (text loss only when masking is on)."""
    if text_loss is None:
        return F.avg(link_ce)
    return F.avg(link_ce) + F.lit(lam) * F.avg(text_loss)


# ---------------------------------------------------------------- Spark ML re-aims (M5–M7)

def fit_pair_head(links: DataFrame, max_iter: int = 50):
    """M5: fit a logistic-regression head on pair features of labelled links."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    train = links.select(array_to_vector(pair_features()).alias("features"),
                         F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=0.01).fit(train)


def apply_pair_head(model, links: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    feat = links.withColumn("features", array_to_vector(pair_features()))
    out = model.transform(feat)
    return out.withColumn("p", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability")


def text_vectors(corpus: DataFrame, id_cols: list[str], text_col: str = "text", among: Column | None = None) -> DataFrame:
    """M6 / M7: L2-normed TF-IDF vectors in long form, ``(id…, term_id, weight)``, fitted on the whole corpus (records
    of all splits and class rows).

    Every word of every text counts. Term ids are the corpus vocabulary's frequency ranks, so no two words share a
    dimension; idf = ln((N + 1) / (df + 1)). Texts, not their many words, are dealt by id, into as many tasks as their size
    asks for; a text's words are counted where it lies and staged. The vocabulary's frequent head (:data:`HEAD_WORDS` words
    of up to :data:`HEAD_CHARS` characters) is sent out, so that no word has to move to meet it; only words outside it meet the
    rest in a join keyed by the word. What moves once more are ids and weights, for the norm.

    With ``among``, a condition on the ids, only terms that occur in a text which meets it are returned, with the weights that
    they have in the whole vectors: norms are summed where the words lie, and only those terms move to meet them.
    """
    n = corpus.count()
    dealt = corpus.repartition(range_count(corpus, HASH_BYTES), *id_cols)
    terms = write_and_read(dealt.select(*id_cols, F.explode(words(F.col(text_col))).alias("token"))
                           .groupBy(*id_cols, "token").agg(F.count(F.lit(1)).alias("tf")), "text-terms")
    voc = terms.groupBy("token").agg(F.sum("tf").alias("cnt"), F.count(F.lit(1)).alias("df"))
    voc = exact_row_number(voc.withColumn("_neg", -F.col("cnt")), [], ["_neg", "token"], out_col="_rn")
    voc = voc.select(F.col("token").alias("_token"), (F.col("_rn") - 1 + len(RESERVED)).alias("term_id"),
                     F.log(F.lit(n + 1.0) / (F.col("df") + 1.0)).alias("_idf"))
    some = [] if among is None else ["_some"]
    if some:
        of = write_and_read(terms.filter(among).select("token").distinct(), "text-among")
        voc = voc.join(of, F.col("_token") == F.col("token"), "left").withColumn("_some", F.col("token").isNotNull()).drop("token")
    in_head = (F.col("term_id") < len(RESERVED) + HEAD_WORDS) & (F.length("_token") <= HEAD_CHARS)
    # the head is bounded in rows and characters: sent out whatever the session's limit is, as in encode
    head = F.broadcast(write_and_read(voc.filter(in_head), "text-head"))
    looked = terms.join(head, F.col("token") == F.col("_token"), "left")
    rest = (looked.filter(F.col("_token").isNull()).select(*id_cols, "token", "tf")
            .join(voc.filter(~in_head), F.col("token") == F.col("_token")))
    raw = looked.filter(F.col("_token").isNotNull()).unionByName(rest)
    raw = raw.select(*id_cols, "term_id", (F.col("tf") * F.col("_idf")).alias("_w"), *some)
    square = F.sum(F.col("_w") * F.col("_w"))
    if some:
        norms = raw.groupBy(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(id_cols)]).agg(F.sqrt(square).alias("_norm"))
        same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(id_cols)]
        normed = raw.filter("_some").join(norms, same)
    else:
        normed = raw.withColumn("_norm", F.sqrt(square.over(Window.partitionBy(*id_cols))))
    return normed.select(
        *id_cols, "term_id", F.when(F.col("_norm") > 0, F.col("_w") / F.col("_norm")).otherwise(0.0).alias("weight"))
