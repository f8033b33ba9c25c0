"""Splits, sampling and batching.

Masks are boolean columns ``is_train, is_val, is_test`` (and ``is_class`` on
class rows); they may overlap (D3), so a split is never one enum column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolink.functions.keys import hash_u32, order_key
from taxolink.functions.mathx import floor_frac
from taxolink.functions.time import after_days, zoned_year_start
from taxolink.operators.ranking import exact_row_number
from taxolink.session import write_and_read

SPLITS = ("train", "val", "test")
MASKS = tuple(f"is_{s}" for s in SPLITS)


def year_window(first_year: int, last_year: int, tz: str = "US/Eastern") -> tuple[Column, Column]:
    """F9 + F10: open window (Jan 1 of ``first_year``, Jan 1 of ``last_year`` + 365 days) in ``tz``.
    In a leap ``last_year`` Dec 31 falls outside, as in the reference."""
    return zoned_year_start(first_year, tz), after_days(zoned_year_start(last_year, tz), 365)


def temporal_split(records: DataFrame, labelled: Column, ts_col: str,
                   windows: dict[str, tuple[int, int]], tz: str = "US/Eastern") -> DataFrame:
    """Labelled rows go to the first window (train, val, test order) that holds
    their instant strictly inside; rows outside every window are in no mask."""
    ts = F.col(ts_col).cast("timestamp")
    out = records.withColumn("_lab", labelled)
    taken = F.lit(False)
    for split in SPLITS:
        lo, hi = year_window(*windows[split], tz=tz)
        inside = F.col("_lab") & (ts > lo) & (ts < hi)
        out = out.withColumn(f"is_{split}", F.coalesce(inside & ~taken, F.lit(False)))
        taken = taken | F.col(f"is_{split}")
    return out.drop("_lab")


def any_mask(*masks: str) -> Column:
    """Element-wise OR of mask columns."""
    m = F.lit(False)
    for c in masks or MASKS:
        m = m | F.col(c)
    return m


def split_sizes(df: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """Number of rows in each mask."""
    return df.agg(*[F.count_if(F.col(m)).alias(f"n_{m[3:]}") for m in masks])


def class_cap(train_codes: DataFrame, id_col: str, code_col: str, cap: int = 500,
              seed: int = 42) -> DataFrame:
    """Per raw code (codes outside the catalogue form groups too) keep at most ``cap``
    training rows, drawn by the seeded md5 order; a row is kept if any of its groups keeps it.

    ``row_number() <= cap`` is planned as a partial WindowGroupLimit before the
    shuffle, so a group holding a third of all rows ships at most ``cap`` rows per
    map task. Spark plans that limit up to a threshold only; larger caps are ranked by
    :func:`exact_row_number`. Returns the distinct kept ids.
    """
    keyed = train_codes.withColumn("_k", order_key(seed, F.col(code_col), F.col(id_col)))
    limit = int(train_codes.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if cap <= limit:
        w = Window.partitionBy(code_col).orderBy("_k", id_col)
        ranked = keyed.withColumn("_rn", F.row_number().over(w))
    else:
        ranked = exact_row_number(keyed, [code_col], ["_k", id_col], out_col="_rn")
    return ranked.filter(F.col("_rn") <= cap).select(id_col).distinct()


def stratified_split(pool_labels: DataFrame, id_col: str = "row_id", class_col: str = "class_idx",
                     train_frac: float = 0.70, val_frac: float = 0.10, seed: int = 42) -> DataFrame:
    """Per class, shuffle its rows (md5 order), first int(n·train) go to train,
    the next int(n·val) to val, the rest to test. A row with several classes is dealt once per
    class, so its masks may overlap. Returns ``(id, is_train, is_val, is_test)``.

    Exact ranks come from :func:`exact_row_number`, so a class holding a third of
    all rows is still numbered by many tasks.
    """
    keyed = pool_labels.select(id_col, class_col).withColumn(
        "_k", order_key(seed, F.col(class_col), F.col(id_col)))
    ranked = exact_row_number(keyed, [class_col], ["_k", id_col], out_col="_rn", size_col="_cnt")
    dealt = (ranked.withColumn("_ntr", floor_frac("_cnt", train_frac))
                   .withColumn("_nva", floor_frac("_cnt", val_frac)))
    return (dealt.groupBy(id_col).agg(
        F.bool_or(F.col("_rn") <= F.col("_ntr")).alias("is_train"),
        F.bool_or((F.col("_rn") > F.col("_ntr")) & (F.col("_rn") <= F.col("_ntr") + F.col("_nva"))).alias("is_val"),
        F.bool_or(F.col("_rn") > F.col("_ntr") + F.col("_nva")).alias("is_test")))


def reset_masks(rows: DataFrame, assigned: DataFrame, id_col: str,
                masks: Sequence[str] = MASKS) -> DataFrame:
    """Clear the masks of ``rows`` and set them from ``assigned`` (missing rows → all false)."""
    base = rows.drop(*[m for m in masks if m in rows.columns])
    joined = base.join(assigned.select(id_col, *masks), id_col, "left")
    return joined.withColumns({m: F.coalesce(F.col(m), F.lit(False)) for m in masks})


def take_sample(rows: DataFrame, id_col: str, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement in seeded md5 order (a top-n, planned as
    TakeOrderedAndProject: each task keeps its own n, the driver merges n × tasks)."""
    return rows.orderBy(order_key(seed, F.col(id_col)), id_col).limit(n)


def batches(rows: DataFrame, id_col: str, batch_size: int, shuffle, seed: int = 42,
            group_col: str | None = None) -> DataFrame:
    """``batch_id = floor(row_index / B)``; row index by id (sequential loaders) or by
    seeded md5 order (the shuffled training loader). ``shuffle`` is a bool or a boolean column
    (e.g. true for the training split only). Computed with :func:`exact_row_number`, so no
    single task numbers the whole split."""
    if isinstance(shuffle, bool):
        shuffle = F.lit(shuffle)
    keyed = rows.withColumn("_k", F.when(shuffle, order_key(seed, F.col(id_col))).otherwise(F.lit("")))
    groups = [group_col] if group_col else []
    ranked = exact_row_number(keyed, groups, ["_k", id_col], out_col="_rn")
    return (ranked.withColumn("batch_id", F.floor((F.col("_rn") - 1) / F.lit(batch_size)).cast("long"))
                  .withColumn("row_index", (F.col("_rn") - 1).cast("long"))
                  .drop("_k", "_rn"))


def n_batches(n_rows: Column, batch_size: int) -> Column:
    """ceil(n / B)."""
    return F.ceil(n_rows / F.lit(batch_size)).cast("long")


def dataset_variant(variant: str, records: DataFrame, labels: DataFrame,
                    windows: dict[str, tuple[int, int]], ts_col: str = "ts", seed: int = 42,
                    train_frac: float = 0.70, val_frac: float = 0.10) -> DataFrame:
    """Masks of the chosen dataset variant, ``(row_id, is_train, is_val, is_test)``.

    ``temporal``: labelled records by time window; ``random``: the stratified split of the rows
    the temporal windows pool. (The ``dummy`` variant is :func:`taxolink.sources.fixtures.dummy_dataset`.)
    """
    rows_ = records.select("row_id", ts_col).join(labels, "row_id")
    temporal = temporal_split(rows_, F.lit(True), ts_col, windows)
    if variant == "temporal":
        return temporal.select("row_id", *MASKS).distinct()
    if variant == "random":
        pool = temporal.filter(any_mask()).select("row_id", "class_idx")
        return stratified_split(pool, "row_id", "class_idx", train_frac, val_frac, seed)
    raise ValueError(f"unknown dataset variant {variant!r}")


def permuted(index: Column, n: int, *key, rounds: int = 4) -> Column:
    """A keyed permutation of 0..n-1 as an expression of one row: no sort, no shuffle.

    A Feistel network on an a × b grid just above n (one coordinate is moved by a hash of the other, in turns) is a
    permutation of the grid; a place outside 0..n-1 is permuted again until it is inside. At most a·b − n < a places are outside, so
    that few turns are needed; their number is bounded by that count, or by 64 for grids so large that 64 turns never are.
    """
    if n <= 1:
        return F.lit(0).cast("long") * index
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(x: Column) -> Column:
        left, right = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
        for k in range(rounds):
            if k % 2 == 0:
                left = (left + hash_u32(*key, F.lit(k), right)) % F.lit(a)
            else:
                right = (right + hash_u32(*key, F.lit(k), left)) % F.lit(b)
        return left * F.lit(b) + right

    start = once(index.cast("long"))
    turns = min(a * b - n, 64)
    if not turns:
        return start
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, lambda x, _: F.when(x < n, x).otherwise(once(x)))


def epoch_batches(rows: DataFrame, id_col: str, batch_size: int, epochs: int, seed: int = 42) -> DataFrame:
    """Every row's batch in every epoch, ``(id, epoch, position, batch_id)``; the rows are numbered once, each epoch's order
    is a keyed permutation of these numbers. ``ceil(n / B)`` batches an epoch (:func:`n_batches`)."""
    numbered = exact_row_number(rows.select(id_col), [], [id_col], out_col="_rn")
    numbered = write_and_read(numbered, "epoch-rows")
    n = numbered.count()
    out = numbered.select(id_col, "_rn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))).alias("epoch"))
    out = out.withColumn("position", permuted(F.col("_rn") - 1, n, seed, F.col("epoch")))
    return out.select(id_col, "epoch", "position", F.floor(F.col("position") / F.lit(batch_size)).cast("long").alias("batch_id"))
