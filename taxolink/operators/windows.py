"""Date windows as a table (J5): an interval join by buckets.

A window of n days is cut into buckets of ``2**level`` days, the level following its length, so that it meets five buckets at most,
whatever its length. Of the windows that cover a whole bucket only the one of first priority can win there, and windows
behind it never can: they are dropped, so that thousands of overlapping windows leave few rows per bucket. Each day that has
records looks up one bucket for each level that occurs, and the same rule leaves few windows per day. Records meet the
windows of their day only, once; the exact bounds are checked there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolink.session import write_and_read

_DAY = 86400


def _day(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(_DAY * 1_000_000)).cast("long")


def _start(bucket: Column, level: Column) -> Column:
    """First second of a bucket."""
    return F.call_function("shiftleft", bucket, level) * F.lit(_DAY)


def window_buckets(windows: DataFrame) -> DataFrame:
    """``(level, bucket, lo, hi, priority, window_id)`` rows that can win, from ``(window_id, lo, hi, priority)``.

    Windows are open (``lo < ts < hi``); those that are empty, or have a null bound or priority, are dropped.
    """
    w = windows.select("window_id", F.col("lo").cast("timestamp").alias("lo"), F.col("hi").cast("timestamp").alias("hi"), "priority")
    w = w.filter((F.col("lo") < F.col("hi")) & F.col("priority").isNotNull())
    days = _day(F.col("hi")) - _day(F.col("lo")) + 1
    w = w.withColumn("level", F.greatest(F.lit(0), F.floor(F.log2(days.cast("double"))).cast("int") - 1))
    first = F.call_function("shiftright", _day(F.col("lo")), F.col("level"))
    last = F.call_function("shiftright", _day(F.col("hi")), F.col("level"))
    w = w.withColumn("bucket", F.explode(F.sequence(first, last)))
    covers = ((F.unix_micros("lo") < _start(F.col("bucket"), F.col("level")) * 1_000_000)
              & (F.unix_micros("hi") >= _start(F.col("bucket") + 1, F.col("level")) * 1_000_000))
    w = write_and_read(w.withColumn("covers", covers), "window-buckets")
    best = (w.filter("covers").groupBy("level", "bucket")
            .agg(F.min(F.struct("priority", "window_id")).alias("best")))
    rank = F.struct("priority", "window_id")
    kept = w.join(best, ["level", "bucket"], "left").filter(F.col("best").isNull() | (rank <= F.col("best")))
    return kept.select("level", "bucket", "lo", "hi", "priority", "window_id")


def day_windows(days: DataFrame, buckets: DataFrame, levels: list[int]) -> DataFrame:
    """``(day, lo, hi, priority, window_id)`` rows that can win on one of ``days`` (``day``, distinct), cut to what of the
    window counts on that day; of windows with equal cut bounds the first stays."""
    start, end = (F.timestamp_micros((F.col("day") + more) * F.lit(_DAY * 1_000_000) - less) for more, less in ((0, 1), (1, 0)))
    near = days.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    near = near.withColumn("bucket", F.call_function("shiftright", F.col("day"), F.col("level"))).join(buckets, ["level", "bucket"])
    near = (near.filter((F.col("lo") < end) & (F.col("hi") > start))
            .groupBy("day", F.greatest("lo", start).alias("lo"), F.least("hi", end).alias("hi"))
            .agg(F.min(F.struct("priority", "window_id")).alias("rank")))
    near = write_and_read(near, "window-near")
    best = near.filter((F.col("lo") == start) & (F.col("hi") == end)).select("day", F.col("rank").alias("best"))
    kept = near.join(best, "day", "left").filter(F.col("best").isNull() | (F.col("rank") <= F.col("best")))
    return kept.select("day", "lo", "hi", "rank.priority", "rank.window_id")


def first_window(records: DataFrame, windows: DataFrame, id_col: str = "row_id", ts_col: str = "ts") -> DataFrame:
    """Per record the window of first priority (ties: smaller id) that holds its instant strictly inside:
    ``(id, window_id)``; null where there is none. The levels that occur (at most 50) reach the driver."""
    buckets = write_and_read(window_buckets(windows), "window-rows")
    levels = sorted(r["level"] for r in buckets.select("level").distinct().collect())
    ts = F.col(ts_col).cast("timestamp")
    dated = records.select(id_col, ts.alias("_ts"), _day(ts).alias("day"))
    if not levels:
        return records.select(id_col, F.lit(None).cast(windows.schema["window_id"].dataType).alias("window_id"))
    days = dated.filter(F.col("day").isNotNull()).select("day").distinct()
    hit = dated.join(write_and_read(day_windows(days, buckets, levels), "window-days"), "day", "left")
    inside = (F.col("_ts") > F.col("lo")) & (F.col("_ts") < F.col("hi"))
    best = F.min(F.when(inside, F.struct("priority", "window_id")))
    return hit.groupBy(id_col).agg(best.alias("_best")).select(id_col, F.col("_best.window_id").alias("window_id"))
