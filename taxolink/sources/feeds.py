"""Record feeds.

A feed holds nested record items: an id, a list of descriptions and a list of
problem-type entries, each with a list of label values, plus a published time.
Two layouts are read with the same explicit schema (no inference pass):

* one multi-line JSON object per year with an array of items (the published
  layout; a file is one task, so a year's file is the unit of parallelism), and
* JSON lines with one item per line (splittable, the layout to stage at scale).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolink.functions.time import parse_zoned_ts

_LV = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("value", T.StringType())]))
ITEM_SCHEMA = T.StructType([
    T.StructField("cve", T.StructType([
        T.StructField("CVE_data_meta", T.StructType([T.StructField("ID", T.StringType())])),
        T.StructField("problemtype", T.StructType([
            T.StructField("problemtype_data", T.ArrayType(T.StructType([T.StructField("description", _LV)])))])),
        T.StructField("description", T.StructType([T.StructField("description_data", _LV)])),
    ])),
    T.StructField("publishedDate", T.StringType()),
])
FEED_SCHEMA = T.StructType([
    T.StructField("CVE_data_type", T.StringType()),
    T.StructField("CVE_data_numberOfCVEs", T.StringType()),
    T.StructField("CVE_Items", T.ArrayType(ITEM_SCHEMA)),
])

WITHDRAWN_MARKER = "REJECT"
TS_FORMAT = "yyyy-MM-dd'T'HH:mmX"


def year_paths(root: str, years: Iterable[int], pattern: str = "nvdcve-1.1-{year}.json") -> list[str]:
    """One path per configured year (inclusive range given as a list); only these are opened."""
    return [f"{root.rstrip('/')}/{pattern.format(year=y)}" for y in years]


def read_feed(spark: SparkSession, paths: list[str], json_lines: bool = False) -> DataFrame:
    """Items of all given files, outer scalars kept beside each item."""
    if json_lines:
        return spark.read.schema(ITEM_SCHEMA).json(paths)
    yearly = spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(paths)
    return yearly.select("CVE_data_type", F.inline("CVE_Items"))


def process_feed(items: DataFrame, marker: str = WITHDRAWN_MARKER, ts_format: str = TS_FORMAT,
                 keep: Iterable[str] = ()) -> DataFrame:
    """``(record_id, published_ts, text, labels)``, then the outer columns named in ``keep``.

    The first description is the text; records whose first description is missing or
    contains ``marker`` (case-sensitive) are withdrawn. Labels are the values of the first
    problem-type entry only, ``['NONE']`` when there are none.
    """
    first_desc = F.get(F.col("cve.description.description_data"), 0)["value"]
    kept = items.filter(first_desc.isNotNull() & ~first_desc.contains(marker))
    first_pt = F.get(F.col("cve.problemtype.problemtype_data"), 0)["description"]
    vals = F.transform(first_pt, lambda x: x["value"])
    labels = F.when(F.coalesce(F.size(vals), F.lit(-1)) > 0, vals).otherwise(F.array(F.lit("NONE")))
    return kept.select(
        F.col("cve.CVE_data_meta.ID").alias("record_id"),
        parse_zoned_ts("publishedDate", ts_format).alias("published_ts"),
        F.coalesce(first_desc, F.lit("NONE")).alias("text"),
        labels.alias("labels"),
        *keep)


def remap_unknown(col, sentinels=("NVD-CWE-Other", "NVD-CWE-noinfo")) -> F.Column:
    """P10: the two sentinel codes become ``UNKNOWN``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*sentinels), F.lit("UNKNOWN")).otherwise(c)


def known_code(col) -> F.Column:
    """False for ``UNKNOWN`` / ``NONE`` (the row is dropped)."""
    c = F.col(col) if isinstance(col, str) else col
    return ~c.isin("UNKNOWN", "NONE")


def feed_gaps(spark: SparkSession, staged_years: DataFrame, years: Iterable[int]) -> DataFrame:
    """Expected years without a staged file (``staged_years`` has a ``year`` column)."""
    exp = spark.createDataFrame([(int(y),) for y in years], "year long")
    return exp.join(staged_years.select(F.col("year").cast("long")).distinct(), "year", "left_anti")


def staged_years(spark: SparkSession, root: str, year_regex: str = r"(\d{4})\.json") -> DataFrame:
    """Years of the feed files present under ``root`` (file listing, contents not read)."""
    files = spark.read.format("binaryFile").load(root).select("path")
    return files.select(F.regexp_extract("path", year_regex, 1).try_cast("long").alias("year")).dropna()


def staged_files(spark: SparkSession, root: str, years: Iterable[int], year_regex: str = r"(\d{4})\.json",
                 json_lines: bool = False) -> DataFrame:
    """What is staged under ``root`` against the expected years: ``(year, n_files, n_items, n_broken, status)``.

    The listing comes from file metadata and the year from the path; items (lines with a record) are counted per file, and what cannot be read counts as
    broken (a line, or a whole file in the layout of one object). Status: ``missing`` (no file), ``broken``, ``unexpected``
    (a year that is not expected), else ``ok``; a file without items is ``ok`` with none, one without bytes
    is not listed by Spark and counts as missing. Files without a year are left out.
    """
    shape = ITEM_SCHEMA if json_lines else FEED_SCHEMA
    read = (spark.read.schema(T.StructType([*shape.fields, T.StructField("_broken", T.StringType())]))
            .option("columnNameOfCorruptRecord", "_broken").option("multiLine", not json_lines)
            .option("recursiveFileLookup", True).json(root))
    items = F.col("cve").isNotNull().cast("long") if json_lines else F.coalesce(F.size("CVE_Items"), F.lit(0)).cast("long")
    per = (read.select(F.col("_metadata.file_path").alias("path"), F.col("_broken").isNotNull().alias("broken"), items.alias("items"))
           .groupBy("path").agg(F.sum(F.when(F.col("broken"), F.lit(0).cast("long")).otherwise(F.col("items"))).alias("n_items"),
                                F.count_if("broken").alias("n_broken")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")

    def plain(c):  # the two readers write one file's path with different numbers of slashes
        return F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")

    per = per.select(plain(F.col("path")).alias("path"), "n_items", "n_broken")
    found = (files.select(plain(F.col("path")).alias("path")).join(per, "path", "left")
             .withColumn("year", F.regexp_extract("path", year_regex, 1).try_cast("long")).dropna(subset=["year"])
             .groupBy("year").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
                                  F.coalesce(F.sum("n_broken"), F.lit(0)).alias("n_broken")))
    expected = spark.createDataFrame([(int(y), True) for y in years], "year long, expected boolean")
    zero = F.lit(0).cast("long")
    status = (F.when(F.col("n_files").isNull(), "missing").when(F.col("n_broken") > 0, "broken")
              .when(F.col("expected").isNull(), "unexpected").otherwise("ok"))
    return found.join(expected, "year", "full").select(
        "year", F.coalesce("n_files", zero).alias("n_files"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("n_broken", zero).alias("n_broken"), status.alias("status"))
