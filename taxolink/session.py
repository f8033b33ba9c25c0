"""Session helper: UTC clock, AQE on, ANSI left on; intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "taxolink", checkpoint_dir: str | None = None) -> SparkSession:
    """Build (or reuse) a session configured for the operators in this package.

    On a cluster ``master`` and ``checkpoint_dir`` stay ``None`` and the launcher decides both;
    tests and the bench pass a ``local[N]`` master and may pass a folder of their own.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Read only: the setting belongs to the launcher. Operators that write intermediate tables
    need it; all others run without.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("this operator writes intermediate tables: start the session with "
                         "spark.checkpoint.dir set to a folder that the driver and all executors share")
    return root.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The run folder of this application under the shared folder; all its written tables sit in it."""
    return f"{checkpoint_root(spark)}/taxolink-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder in the run folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release_scratch(spark: SparkSession) -> bool:
    """Delete the run folder with every intermediate table of this application.

    Call it when results that read those tables have been written. True if a folder was there.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_WATCHERS: list[list[tuple[str, str]]] = []


@contextmanager
def written_plans():
    """Collect ``(name, physical plan)`` of every intermediate table written inside the block."""
    seen: list[tuple[str, str]] = []
    _WATCHERS.append(seen)
    try:
        yield seen
    finally:
        _WATCHERS.remove(seen)


def write_and_read(df, name: str):
    """Write ``df`` once as Parquet into the run folder and read it back: one computation,
    columnar storage, and lineage cut (a lost executor re-reads files)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for seen in _WATCHERS:
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
