"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bag-of-n-grams models over hashed buckets are counted: the target text (documents labelled good) and the raw text
(all documents). A document's importance is the ratio of the two models' probabilities of its n-grams. Documents are
then drawn without replacement in proportion to their importance, by adding Gumbel noise to the log
importance and taking the k largest.

N-grams: words, word pairs, word shapes and pairs of shapes (:func:`ngrams`). A shape tells which kinds of
characters a word has, how it begins and ends, its rough length, and whether it repeats the word before it; so text
made of unseen words is judged by its form. Each family has its own buckets. The target model
is smoothed with the raw model, so an n-gram that the labelled text never had counts little.

The labelled documents split in two by a hash of their ids: one half makes the target model, the other calibrates:
the log ratio per n-gram that separates good from bad labels best becomes the prior per n-gram, and k the
number of documents above it. At most :data:`MAX_LABELS` labelled documents (smallest hashes first) are used; raw
counts, scores and the draw cover all documents.

Defined results: documents without words or with null text are rejected; without labels of both kinds, everything
is kept; conflicting labels count as bad; null labels and labels of unknown documents are ignored; a null id
is hashed like 0; rows that tie with the k-th are all kept, so repeated rows stay or go together; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolink.llm.words import SPACE, enter, mix, span_hashes, text_chunks, word_spans
from taxolink.session import write_and_read

BUCKETS = 1 << 16  # per family
FAMILIES = 4
MAX_LABELS = 200_000
#: Weight of the raw model in the target model's smoothing, in n-grams per bucket; never more than the target's own.
SMOOTHING = 1.0

_KIND = np.full(256, 8, np.uint8)  # other ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 16
_KIND[SPACE] = 0
_CAPITAL = np.zeros(256, np.uint64)
_CAPITAL[65:91] = 1


def ngrams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Buckets of every word's n-grams: one row per family, one column per word."""
    words = span_hashes(buf, starts, ends)
    if not len(words):
        return np.zeros((FAMILIES, 0), np.int64)
    first = before[:-1][before[:-1] < len(words)]  # first words of texts have nothing before them
    last = buf[ends - 1]
    repeated = np.zeros(len(words), np.uint64)
    repeated[1:] = words[1:] == words[:-1]
    repeated[first] = 0
    shape = np.bitwise_or.reduceat(_KIND[buf], starts).astype(np.uint64)
    shape |= _CAPITAL[buf[starts]] << np.uint64(6)
    shape |= np.where(_KIND[last] == 8, last, 0).astype(np.uint64) << np.uint64(7)
    shape |= np.minimum(np.log2(ends - starts), 5).astype(np.uint64) << np.uint64(15)
    shape = mix(shape | repeated << np.uint64(20) | np.uint64(1 << 40))

    def paired(x: np.ndarray) -> np.ndarray:
        previous = np.roll(x, 1)
        previous[first] = 7
        return mix(x * np.uint64(3) + previous)

    kinds = (words, paired(words), shape, paired(shape))
    return np.stack([(k & np.uint64(BUCKETS - 1)).astype(np.int64) + j * BUCKETS for j, k in enumerate(kinds)])


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``(bucket, raw, target)`` over documents ``(text, good)``: one row per bucket and task, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("resampling")
        raw, target = (np.zeros(FAMILIES * BUCKETS, np.int64) for _ in range(2))
        for batch in batches:
            good = pc.fill_null(batch.column(1), False).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in text_chunks(batch):
                starts, ends, before = word_spans(buf, offsets)
                found = ngrams(buf, starts, ends, before)
                raw += np.bincount(found.ravel(), minlength=len(raw))
                chosen = np.repeat(good[lo:hi], np.diff(before))
                if chosen.any():
                    target += np.bincount(found[:, chosen].ravel(), minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])],
                                         names=["bucket", "raw", "target"])

    counts = docs.select(F.col("text").cast("string"), "good").mapInArrow(run, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, log of target over raw probability; 0 for n-grams that no document has."""
    out = np.zeros(FAMILIES * BUCKETS)
    for j in range(FAMILIES):
        part = slice(j * BUCKETS, (j + 1) * BUCKETS)
        r, t = raw[part].astype(float), target[part].astype(float)
        if not r.sum() or not t.sum():
            continue
        p, weight = r / r.sum(), min(SMOOTHING * BUCKETS, t.sum())
        q = (t + weight * p) / (t.sum() + weight)
        some = r > 0
        out[part][some] = np.log(q[some]) - np.log(p[some])
    return out


@dataclass
class Model:
    """What a fit gives: ratios per bucket, prior per n-gram, and the smallest key that the draw keeps."""
    ratios: np.ndarray
    prior: float
    cut: float
    seed: int


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise that depends on id and seed only."""
    u = (mix(mix(ids.astype(np.int64).view(np.uint64)) ^ np.uint64(seed)) >> np.uint64(11)).astype(float)
    return -np.log(-np.log((u + 0.5) / float(1 << 53)))


def _scores(batch: pa.RecordBatch, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio and number of n-grams per row."""
    total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
    for lo, hi, buf, offsets in text_chunks(batch):
        starts, ends, before = word_spans(buf, offsets)
        per_word = ratios[ngrams(buf, starts, ends, before)].sum(axis=0)
        # sums inside one text only: a text's score must not depend on the texts before it
        for i in range(hi - lo):
            total[lo + i] = per_word[before[i]:before[i + 1]].sum()
        count[lo:hi] = FAMILIES * np.diff(before)
    return total, count


def score_documents(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``(doc_id, log_ratio, n_ngrams)`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("resampling")
        for batch in batches:
            total, count = _scores(batch, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(count)],
                                             names=["doc_id", "log_ratio", "n_ngrams"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, log_ratio double, n_ngrams long")


def best_split(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the best balanced accuracy, halfway between the scores at its sides."""
    if not len(scores) or good.all() or not good.any():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    rejected_bad, rejected_good = np.cumsum(~g) / (~g).sum(), np.cumsum(g) / g.sum()
    best = int(np.argmax(np.concatenate([[0.0], rejected_bad - rejected_good])))
    if best == 0:
        return float("-inf")
    return float(s[-1]) + 1.0 if best == len(s) else float((s[best - 1] + s[best]) / 2)


def kth_largest(keys: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest ``key`` of a table, by counting ever narrower bins; -inf if there are fewer."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low is not None and low < high:
        step = (high - low) / bins
        if step <= 0 or low + step == low or high - step == high:
            break
        b = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        counts = {r[0]: (r[1], r[2], r[3]) for r in keys.filter((F.col("key") >= low) & (F.col("key") <= high))
                  .groupBy(b.alias("b")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect()}
        for at in sorted(counts, reverse=True):
            n, low, high = counts[at]
            if above + n >= k:
                break
            above += n
        else:
            return float("-inf")
    return low if low is not None else float("-inf")


def fit(docs: DataFrame, labels: DataFrame, seed: int = 23) -> tuple[Model, DataFrame]:
    """Fit on documents ``(doc_id, text)`` and labels ``(doc_id, quality)`` (1 good, 0 bad).

    Returns the model and the written table ``(doc_id, log_ratio, n_ngrams, key)`` of all documents. Two passes over the texts.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
             .dropna().groupBy("label_id").agg((F.min("quality") >= 1).alias("good"))
             .orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(MAX_LABELS)
             .withColumn("fits", F.pmod(F.xxhash64(F.lit(seed + 1), "label_id"), F.lit(2)) == 0))
    known = write_and_read(known, "quality-labels")
    target = known.filter("fits and good").select("label_id", "good")
    counts = count_ngrams(docs.select("doc_id", "text").join(
        F.broadcast(target), F.col("doc_id") == F.col("label_id"), "left")).toArrow()
    raw, wanted = (np.zeros(FAMILIES * BUCKETS, np.int64) for _ in range(2))
    at = counts.column("bucket").to_numpy()
    raw[at], wanted[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    ratios = log_ratios(raw, wanted)

    scored = write_and_read(score_documents(docs, ratios), "quality-scores")
    held = (scored.join(F.broadcast(known.filter("not fits")), F.col("doc_id") == F.col("label_id"))
            .filter("n_ngrams > 0").groupBy("label_id").agg(F.first("good").alias("good"),
                                                           F.max(F.col("log_ratio") / F.col("n_ngrams")).alias("score"))
            .select("score", "good").toArrow())
    good = held.column("good").to_numpy().astype(bool)
    prior = best_split(held.column("score").to_numpy(), good) if wanted.any() else float("-inf")
    if prior == float("-inf"):
        return Model(ratios, 0.0, float("-inf"), seed), scored.withColumn("key", F.lit(0.0))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_keys(
                batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), prior, seed))],
                names=["doc_id", "log_ratio", "n_ngrams", "key"])

    drawn = write_and_read(scored.mapInArrow(draw, "doc_id long, log_ratio double, n_ngrams long, key double"),
                           "quality-keys")
    some = drawn.filter("n_ngrams > 0")
    k = some.filter(F.col("log_ratio") >= F.lit(prior) * F.col("n_ngrams")).count()
    return Model(ratios, prior, kth_largest(some, k) if k else float("inf"), seed), drawn


def _keys(ids: pa.Array, total: np.ndarray, count: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Log importance beyond the prior, plus Gumbel noise; -inf for rows without n-grams."""
    noise = gumbel(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), seed)
    return np.where(count > 0, total - prior * count + noise, -np.inf)


def sampled_scores(drawn: DataFrame, model: Model) -> DataFrame:
    """The documents that the draw keeps: ``(doc_id, log_ratio, n_ngrams, key)``."""
    return drawn if model.cut == float("-inf") else drawn.filter(F.col("key") >= F.lit(model.cut))


def keep_sampled(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, all columns as they are; scored again in one pass, no join."""
    if model.cut == float("-inf"):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("resampling")
        m = sent.value
        for batch in batches:
            total, count = _scores(batch, m.ratios)
            ids = batch.column(names.index("doc_id")).cast(pa.int64())
            kept = batch.filter(pa.array(_keys(ids, total, count, m.prior, m.seed) >= m.cut))
            for lo in range(0, kept.num_rows, 512):  # whole texts go back: in small batches
                yield kept.slice(lo, 512)

    return docs.mapInArrow(run, docs.schema)
