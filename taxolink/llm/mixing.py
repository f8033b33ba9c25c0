"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words (its share of the mix). Whole copies of the source come first; the
rest of the budget is filled by a subset of its documents, chosen in two steps over the histogram of
exact document lengths (one row per source and length, never the documents):

1. lengths in descending order take documents in proportion to the budget, carrying the rounding error on
   (so the mix keeps the source's length distribution), until only a small remaining budget is left;
2. a bounded-knapsack dynamic program over the documents still free fills that remaining budget exactly,
   or as closely as the lengths allow, from below or, if that is nearer, from above (a source of a few very long
   documents goes to it whole).

That gives a number of documents per length. Which ones is decided by a seeded hash: per (source, length)
the documents with the smallest hashes are taken. Hash bins of about :data:`BIN_ROWS` documents are counted, and only the
bin in which the number is reached is ranked, however many documents share a source and a length. What comes out
is one cut-off hash per (source, length): every document is told from its own hash whether it is taken, never joined by id. That
table grows with the number of different lengths, at most as the square root of a source's words; it is broadcast up to 32 MB
(262,144 lengths), so that the texts are not shuffled, and joined by a shuffle on source and length beyond.

Defined results: a null text has size 0; documents of size 0 add no words, and follow their source's whole
copies only; null sources form one source, ordered last; rows repeated with the same id are separate
documents; a source without words has target 0; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolink.llm.sides import checked_side
from taxolink.llm.words import enter
from taxolink.session import write_and_read

#: The dynamic program's budget, in words: what step 1 leaves for step 2 on top of its rounding rest.
DP_WORDS = 1 << 14
BIN_ROWS = 512
#: Copies of one row that a task writes.
BLOCK_COPIES = 4096
#: A source of no more documents, which need no more bits, is fitted by the dynamic program alone.
FEW_DOCS, FEW_BITS = 64, 1 << 28


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009-U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    Sources in code-point order, null last, take the weights in turn and split ``share`` of all words; a
    target stops at ``most`` times its source's size and the excess is shared again by weight among the
    others until none is above. The loop runs on aggregates over the source table only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    per = write_and_read(per, "mix-sources").withColumn("most", F.col("source_size") * F.lit(most))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        fixed, free = per.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        new = (share * total - (fixed or 0.0)) / free
        if new <= level:
            break
        level = new
    return per.select("source", "source_size",
                      F.least(F.col("most"), F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _reachable(lengths: list[int], free: list[int], order: list[int], most: int,
               goal: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Items by binary splitting, and after each the sums up to ``most`` as bits; ends early at ``goal``."""
    items = []
    for i in order:
        if lengths[i] <= most:
            n, block = min(free[i], most // lengths[i]), 1
            while n > 0:
                items.append((i, min(block, n)))
                n -= block
                block *= 2
    mask = (1 << (most + 1)) - 1
    reach = [1]
    for i, n in items:
        reach.append(reach[-1] | (reach[-1] << (lengths[i] * n)) & mask)
        if reach[-1] >> goal & 1:
            break
    return items, reach


def fit_counts(lengths: list[int], counts: list[int], budget: int, dp_words: int = DP_WORDS,
               above: bool = False) -> list[int]:
    """How many documents of each length to take so that their words add up to ``budget`` or just below.

    With ``above``, a sum above the budget is taken if it is nearer; few documents (:data:`FEW_DOCS`) are then all left
    to the dynamic program. ``lengths`` are distinct and positive. Memory: one bit per word of the remaining budget
    (twice that with ``above``) and free item, independent of the number of documents.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    total = sum(x * c for x, c in zip(lengths, counts))
    take = [0] * len(lengths)
    if budget >= total:
        return list(counts)
    if above and dp_words < total and sum(counts) <= FEW_DOCS and 2 * total * sum(counts) <= FEW_BITS:
        dp_words = total
    # step 1: in proportion, leaving dp_words for step 2
    aim, seen, used = max(0, budget - dp_words), 0, 0
    for i in order:
        seen += lengths[i] * counts[i]
        due = aim * seen // total - used
        take[i] = max(0, min(counts[i], due // lengths[i]))
        used += take[i] * lengths[i]
    # long documents that still fit whole, so that the rest is a small budget
    for i in order:
        if lengths[i] > dp_words or budget - used > 4 * dp_words:
            more = min(counts[i] - take[i], max(0, budget - used - dp_words) // lengths[i])
            take[i] += more
            used += more * lengths[i]
    # step 2: reachable sums as bits
    rest = budget - used
    free = [c - t for c, t in zip(counts, take)]
    items, reach = _reachable(lengths, free, order, rest, rest)
    at = reach[-1].bit_length() - 1
    if above and at < rest:
        more, over = _reachable(lengths, free, order, 2 * rest - at - 1, rest)
        higher = over[-1] >> (rest + 1)
        if higher:  # nearer than the best sum below, as sums go up to that distance
            items, reach, at = more, over, rest + (higher & -higher).bit_length()
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> at & 1:
            i, n = items[k - 1]
            take[i] += n
            at -= lengths[i] * n
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies per length of one source: every document ``whole`` times, ``extra`` documents once more."""
    enter("mixing")
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = int(target // size) if size else 0
    budget = round(target - whole * size) if size else 0
    some = pdf["size"] > 0
    pdf["whole"], pdf["extra"] = whole, 0
    pdf.loc[some, "extra"] = fit_counts(pdf.loc[some, "size"].tolist(), pdf.loc[some, "n"].tolist(), budget, above=True)
    return pdf[["source_key", "size", "n", "whole", "extra"]]


def _checksum(docs: DataFrame) -> Column:
    """Of a whole row: tells rows with the same or without an id apart."""
    parts = []
    for f in docs.schema.fields:
        col = docs[f.name]
        parts += [F.to_json(F.struct(col)) if "map<" in f.dataType.simpleString() else col, col.isNull()]
    return F.xxhash64(*parts)


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """``(_document, doc_id, source, source_key, size, checksum, order)`` per row; ``_document`` holds the row itself."""
    source = docs["source"].cast("string")
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_document"), docs["doc_id"].alias("doc_id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("source_key"),
        word_count(docs["text"]).alias("size"), _checksum(docs).alias("checksum")
    ).withColumn("order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "checksum"), 1))


def _cutoffs(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per (source, length) its copies and cut-off: ``(source_key, size, n, source_size, target, whole, extra, cut_order,
    cut_sum, alike, more)``. Of ``alike`` rows exactly at the cut-off, equal in every column, ``more`` come once more."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    hist = rows.groupBy("source", "source_key", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = write_and_read(hist, "mix-lengths")
    targets = write_and_read(
        source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
        .withColumn("source_key", key).drop("source"), "mix-targets")
    plan = (hist.select("source_key", "size", "n").join(targets, "source_key")
            .groupBy("source_key")
            .applyInPandas(_plan, "source_key string, size long, n long, whole long, extra long"))
    plan = write_and_read(plan.join(targets, "source_key"), "mix-plan")

    # documents per bin of about BIN_ROWS hashes, and the bin in which the number wanted is reached
    per = ["source_key", "size"]
    part = plan.filter("extra > 0 and extra < n").select(*per, "extra", F.col("n").alias("of"))
    bins = F.greatest(F.lit(1), (F.col("of") / BIN_ROWS).cast("long"))
    binned = (rows.select(*per, "checksum", "order").join(checked_side(part, 4), per)
              .withColumn("bin", F.floor(F.col("order") / F.lit(float(1 << 63)) * bins)))
    upto = F.sum("in_bin").over(Window.partitionBy(*per).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    edge = (binned.groupBy(*per, "bin", "extra").agg(F.count(F.lit(1)).alias("in_bin"))
            .withColumn("below", upto - F.col("in_bin"))
            .filter("below < extra and extra <= below + in_bin").select(*per, "bin", "below"))
    edge = write_and_read(edge, "mix-bins")
    # inside that bin, the row at which it is reached
    upto = F.sum("alike").over(Window.partitionBy(*per).orderBy("order", "checksum").rowsBetween(Window.unboundedPreceding, 0))
    cut = (binned.join(checked_side(edge, 4), [*per, "bin"])
           .groupBy(*per, "extra", "below", "order", "checksum").agg(F.count(F.lit(1)).alias("alike"))
           .withColumn("more", F.col("extra") - F.col("below") - upto + F.col("alike"))
           .filter("more > 0 and more <= alike")
           .select(*per, F.col("order").alias("cut_order"), F.col("checksum").alias("cut_sum"), "alike", "more"))
    return write_and_read(plan.join(cut, per, "left"), "mix-cutoffs")


#: Rows at a cut-off that only some of their equals pass; all others are decided by their own hash.
_TIED = "more < alike and order = cut_order and checksum = cut_sum"


def _counted(rows: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``copies``, and the tied ones apart (None if there are none)."""
    rows = rows.join(checked_side(cuts, 8), ["source_key", "size"])
    once_more = F.expr("extra >= n or (extra > 0 and (order < cut_order or (order = cut_order and checksum <= cut_sum)))")
    tied = F.coalesce(F.expr(_TIED), F.lit(False))
    if cuts.filter("more < alike").isEmpty():
        return rows.withColumn("copies", (F.col("whole") + F.when(once_more, 1).otherwise(0)).cast("int")), None
    return (rows.filter(~tied).withColumn("copies", (F.col("whole") + F.when(once_more, 1).otherwise(0)).cast("int")),
            rows.filter(tied))


def _numbered(rows: DataFrame, n: Column) -> DataFrame:
    """Every row ``n`` times with ``_nth`` from 1, in blocks that are spread over the tasks first."""
    last = (n - 1) / BLOCK_COPIES
    blocks = rows.filter(n > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last))))
    start = F.col("_block") * BLOCK_COPIES
    return (blocks.repartition("_block")
            .withColumn("_nth", F.explode(F.sequence(start + 1, F.least(n.cast("long"), start + BLOCK_COPIES)))).drop("_block"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        seed: int = 17) -> DataFrame:
    """Copies to take of every document: ``(doc_id, source, size, source_size, target, copies, taken)``.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; the texts are read once, for their word counts. All
    later steps work on narrow rows written to the shared folder.
    """
    rows = write_and_read(_measured(docs, seed).drop("_document"), "mix-sizes")
    out, tied = _counted(rows, _cutoffs(rows, weights, share, most))
    named = ["doc_id", "source", "size", "source_size", "target", "copies"]
    out = out.select(*named)
    if tied is not None:  # equal rows: one stands for all, and some of its equals get one more
        same = tied.groupBy("source_key", "size", "checksum").agg(
            *[F.max(c).alias(c) for c in ("doc_id", "source", "source_size", "target", "whole", "alike", "more")])
        once_more = F.when(F.col("_nth") <= F.col("more"), 1).otherwise(0)
        same = _numbered(same, F.col("alike")).withColumn("copies", (F.col("whole") + once_more).cast("int"))
        out = out.unionByName(same.select(*named))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                    seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all columns of ``docs``.

    Each row is told from its own hash how often it comes, so the rows are not shuffled; rows not taken are dropped. Of rows
    equal in every column that only some pass, one is kept per task and repeated as often as all of them are taken.
    """
    rows = write_and_read(_measured(docs, seed).drop("_document"), "mix-sizes")
    out, tied = _counted(_measured(docs, seed), _cutoffs(rows, weights, share, most))
    out = (out.filter("copies > 0").select("_document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_nth"))
           .select("_document.*"))
    if tied is not None:
        same = tied.groupBy("source_key", "size", "checksum").agg(
            F.first("_document").alias("_document"), F.max(F.expr("alike * whole + more")).alias("all"))
        out = out.unionByName(_numbered(same, F.col("all")).select("_document.*"))
    return out
