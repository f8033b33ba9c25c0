"""Exact row numbers per group without a single-task window.

``row_number() over (partition by g order by o)`` sends every row of a group to
one task. When one group holds a third of all rows that task holds a third of
the data. The plan here keeps the exact numbering but spreads a hot group over
many tasks:

1. range-partition on ``(g…, o…)`` – a hot group is cut into many ranges – and
   sort inside each partition;
2. ``monotonically_increasing_id`` gives each row (partition id, local position);
3. a small table of (partition, group) → count, first position
   (at most #partitions + #groups rows) is prefix-summed per group;
4. row number = rows of the group in earlier partitions + position inside the
   partition + 1.

The order columns must make the order total (add the key as a tie-break). The
numbered rows are written once to the shared checkpoint folder and read back,
so the counts and the rows they offset come from the same materialisation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolink.session import write_and_read

_POS_BITS = 33
#: Input bytes per range; more ranges than the shuffle setting are cut when the input is larger.
RANGE_BYTES = 256 << 20
#: The same where a task keeps its distinct rows in memory, many times the bytes of their files.
HASH_BYTES = 16 << 20


def range_count(df: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Ranges for an input: the shuffle setting, or one per ``range_bytes`` of the files it reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # sources without statistics report a huge default
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // range_bytes)


def exact_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                     out_col: str = "rn", num_partitions: int | None = None,
                     size_col: str | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based row number inside ``group_cols`` ordered by ``order_cols``.

    With ``size_col`` the group's number of rows comes along; the table of offsets holds it anyway.
    """
    n = num_partitions or range_count(df)
    group_cols = list(group_cols)
    order_exprs = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    sort_exprs = [F.col(g) for g in group_cols] + order_exprs

    ranged = (df.repartitionByRange(n, *sort_exprs)
                .sortWithinPartitions(*sort_exprs)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_pid", F.shiftright("_mid", _POS_BITS))
                .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    # The range bounds are sampled from the input; when the input order is not fixed (it comes
    # out of a shuffle) two evaluations could cut different ranges. Write the numbered rows once
    # to the shared checkpoint folder, so both uses below read one materialisation (this also
    # cuts the lineage: a lost executor re-reads files instead of recomputing the sort).
    ranged = write_and_read(ranged, "ranked")

    stats = (ranged.groupBy("_pid", *group_cols)
                   .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt")))
    before = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    whole = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    stats = stats.withColumn(
        "_off",
        F.coalesce(F.sum("_cnt").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stats = stats.withColumn("_size", F.sum("_cnt").over(whole))

    keys = ["_pid", *group_cols]
    # stats has at most #partitions + #groups rows; written, so that Spark knows its size when it picks the join
    stats = write_and_read(stats.select(*keys, "_first", "_off", "_size"), "rank-offsets")
    out = ranged.join(stats, keys, "inner").withColumn(out_col, F.col("_off") + F.col("_pos") - F.col("_first") + 1)
    if size_col:
        out = out.withColumn(size_col, F.col("_size"))
    return out.drop("_mid", "_pid", "_pos", "_first", "_off", "_size")


def group_sizes(df: DataFrame, group_cols: Sequence[str], out_col: str = "cnt") -> DataFrame:
    """Count rows per group (partial + final aggregation, no skew issue)."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(out_col))
