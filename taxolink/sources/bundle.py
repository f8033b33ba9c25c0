"""Table bundles, materialise-or-load and run logs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_bundle(bundle: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """One Parquet table per part (labels, splits, edges, depths, ...)."""
    for name, df in bundle.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def load_bundle(spark: SparkSession, root: str, names) -> dict[str, DataFrame]:
    """Read the parts of a bundle back."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was finished: its success marker is there (a part-written target has none)."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker))


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                recompute: bool = False) -> DataFrame:
    """Recompute when forced or when the output is missing or unfinished, else read it back."""
    if recompute or not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


MANIFEST = "version string, at timestamp, fingerprint string, parts array<string>"


def fingerprint(spark: SparkSession, inputs: Sequence[str], params: dict | None = None) -> str:
    """Digest of input tables and parameters. Of a table its files' names, lengths and times count, read as a listing (no
    content) and summed by Spark, so that one row per table reaches the driver."""
    seen = []
    for path in inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        seen.append(files.agg(F.count("path").cast("string"), F.sum("length").cast("string"),
                              F.bit_xor(F.xxhash64("path", "length", "modificationTime")).cast("string")).first())
    said = [sorted([str(p), *r] for p, r in zip(inputs, seen)), params or {}]
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()


def materialize_unit(spark: SparkSession, root: str, build: Callable[[], dict[str, DataFrame]], inputs: Sequence[str],
                     params: dict | None = None, recompute: bool = False) -> dict[str, DataFrame]:
    """S8 for outputs that belong together: all parts of a bundle are of one build, or all are built again.

    A build goes to a folder of its own under ``root``; a manifest row with the fingerprint of the inputs and all part
    names is added last. A build that was killed has no row and is never read. The newest row counts; all parts are built again
    if its fingerprint differs, a part is missing or unfinished, or ``recompute`` asks for it. Earlier builds stay for their
    readers.
    """
    root, now = root.rstrip("/"), fingerprint(spark, inputs, params)
    if not recompute and _complete(spark, f"{root}/manifest"):
        last = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("at"), "version").first()
        if last and last["fingerprint"] == now and all(_complete(spark, f"{root}/{last['version']}/{p}") for p in last["parts"]):
            return load_bundle(spark, f"{root}/{last['version']}", last["parts"])
    version, parts = f"build-{uuid.uuid4().hex[:12]}", build()
    save_bundle(parts, f"{root}/{version}", mode="errorifexists")
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"), F.lit(now).alias("fingerprint"),
                                F.array(*[F.lit(p) for p in parts]).alias("parts"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return load_bundle(spark, f"{root}/{version}", parts)


def log_metrics(spark: SparkSession, path: str, run_id: str, metrics: dict[str, list[float]],
                append: bool = True) -> DataFrame:
    """Named metric lists as ``(run_id, key, pos, value)`` rows, appended (or overwritten)."""
    rows = [(run_id, k, i, float(v)) for k, vals in metrics.items() for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "run_id string, key string, pos int, value double")
    df.write.mode("append" if append else "overwrite").parquet(path)
    return spark.read.parquet(path)


def append_metrics(rows: DataFrame, path: str, append: bool = True) -> None:
    """S9 for metrics computed by Spark: ``(run_id, key, pos, value)`` rows appended (or written
    over) without passing through the driver."""
    rows.select("run_id", "key", F.col("pos").cast("int"), F.col("value").cast("double")) \
        .write.mode("append" if append else "overwrite").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """S9 read side: one ``key :v1 v2 …`` line per run and key, values in position order."""
    m = spark.read.parquet(path)
    vals = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"].cast("string"))
    return m.groupBy("run_id", "key").agg(F.concat(F.col("key"), F.lit(" :"), F.array_join(vals, " ")).alias("line"))
