"""Stand-in tables built from the supplied TPC-H-ish parquet tables.

record   = order (``o_orderkey``, ``o_orderdate``)
labels   = brands of an order's line items (``lineitem ⋈ part``)
classes  = brands in catalogue order (brand number), two brands acting as the sentinel codes
DAG      = part → brand, part → type, type → size band (``'S' || p_size div 10``)
tree     = supplier → nation → region
vectors  = ``embeddings`` (64 floats, label 0–9); class vector = per-label mean
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolink.functions.text import first_int
from taxolink.operators import labels as L
from taxolink.session import table_path

# Fixed values of the stand-in set-up (shared with the SQL oracles).
SEED = 42
SENTINEL_CODES = ("Brand#24", "Brand#25")
TEMPORAL_WINDOWS = {"train": (1995, 1996), "val": (1997, 1998), "test": (1999, 2001)}
WINDOW_ZONE = "US/Eastern"
CLASS_CAP = 500
TRAIN_FRAC, VAL_FRAC = 0.70, 0.10
SAMPLE_N = 100
BATCH_SIZE = 32
K_LINKS, K_SHORT = 120, 5
TEXT_LOSS_WEIGHT = 0.1
THRESHOLD = 0.5
BEAM_TRIPLES = ((1, 1, 1), (3, 2, 1), (5, 2, 2))
# Small class tree over the embedding labels 0..9: child -> parent (-1 = root).
CLASS_TREE = ((0, -1), (1, -1), (2, -1), (3, 0), (4, 0), (5, 1), (6, 1), (7, 2), (8, 3), (9, 3))
EXPECTED_YEARS = tuple(range(1993, 2003))
LEFT_OUT_YEAR, CUT_YEAR = 1996, 1998
WITHDRAWN_MARKER = "License"
MASK_RATE = 0.15


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def record_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw label codes per record: ``(row_id, code)``, sentinel codes included."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pairs = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("row_id"), F.col("p_brand").alias("code"))
    # distinct codes per record via a set per record (bounded by the record's line items, partial
    # sets combined map-side): the result is hash-partitioned by row_id alone, so the joins and
    # groupings on row_id downstream reuse it instead of shuffling the label side again
    per = pairs.groupBy("row_id").agg(F.collect_set("code").alias("_codes"))
    return per.select("row_id", F.explode("_codes").alias("code"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue A: brands ordered by brand number, sentinel codes dropped."""
    part = read(spark, sf_dir, "part").select("p_brand")
    cat = part.select("p_brand", first_int("p_brand").alias("pos"))
    return L.class_index(cat, "p_brand", "pos", drop_names=SENTINEL_CODES)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known labels of records: ``(row_id, class_idx)`` (L3)."""
    return L.encode_labels(record_codes(spark, sf_dir), classes(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("ts"),
                    "o_orderstatus", "o_orderpriority", "o_custkey")


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an ``is_labelled`` flag (L4)."""
    ids = labels(spark, sf_dir).select("row_id").distinct().withColumn("is_labelled", F.lit(True))
    return (records(spark, sf_dir).join(ids, "row_id", "left")
              .withColumn("is_labelled", F.coalesce("is_labelled", F.lit(False))))


# ---------------------------------------------------------------- hierarchy stand-ins
# Node ids: brand n -> n, size band b -> 100 + b, type -> 200 + rank of the type name,
# part k -> 1000 + k.  Tree: region r -> r, nation n -> 100 + n, supplier s -> 1000 + s.
SENTINEL_NODE_IDS = (24, 25)
PART_ID_BASE, TYPE_ID_BASE, BAND_ID_BASE = 1000, 200, 100


def _rel(ids_col) -> F.Column:
    """Relation text in the catalogue's ``::NATURE:ChildOf:CWE ID:<id>:VIEW ID:1000`` form."""
    return F.array_join(F.transform(ids_col, lambda i: F.concat(
        F.lit("::NATURE:ChildOf:CWE ID:"), i.cast("string"), F.lit(":VIEW ID:1000"))), "")


def dag_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows ``(node, name, relation)`` for parts, brands, types and size bands."""
    from pyspark.sql import Window
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    types = (part.select("p_type").distinct()
                 .withColumn("tid", (F.dense_rank().over(Window.orderBy("p_type")) - 1 + TYPE_ID_BASE).cast("long")))
    p = part.join(types, "p_type")
    brand_id = first_int("p_brand").cast("long")
    band_id = (F.floor(F.col("p_size") / 10) + BAND_ID_BASE).cast("long")
    parts = p.select((F.col("p_partkey") + PART_ID_BASE).alias("node"), F.col("p_partkey").cast("string").alias("name"),
                     _rel(F.array(brand_id, F.col("tid"), brand_id)).alias("relation"))
    type_rows = (p.groupBy("tid", "p_type").agg(F.sort_array(F.collect_set(band_id)).alias("bands"))
                  .select(F.col("tid").alias("node"), F.col("p_type").alias("name"), _rel(F.col("bands")).alias("relation")))
    brands = (part.select("p_brand").distinct()
                  .select(brand_id.alias("node"), F.col("p_brand").alias("name"), F.lit("").alias("relation")))
    bands = (part.select(band_id.alias("node")).distinct()
                 .select("node", F.concat(F.lit("S"), (F.col("node") - BAND_ID_BASE).cast("string")).alias("name"),
                         F.lit("").alias("relation")))
    return parts.unionByName(type_rows).unionByName(brands).unionByName(bands)


def dag_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 pipeline on the stand-in catalogue: parse relations, keep valid ids (sentinel brands
    are not valid), ``[-1]`` where nothing is left."""
    from taxolink.operators import taxonomy as H
    from taxolink.session import write_and_read
    # the catalogue is referenced several times below: stage it once instead of re-deriving
    # its four branches for every reference
    cat = write_and_read(dag_catalog(spark, sf_dir), "dag_catalog")
    valid = cat.select("node").filter(~F.col("node").isin(*SENTINEL_NODE_IDS))
    return H.keep_valid(H.parse_parents(cat, "node", "relation"), valid)


def tree_parents(spark: SparkSession, sf_dir: str, suppliers: bool = True) -> DataFrame:
    """Supplier → nation → region as a parents table; nation → region alone without ``suppliers``."""
    sup = read(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1000).alias("node"), F.array((F.col("s_nationkey") + 100).cast("long")).alias("parents"))
    nat = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("long").alias("node"), F.array(F.col("n_regionkey").cast("long")).alias("parents"))
    reg = read(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("node"), F.array(F.lit(-1).cast("long")).alias("parents"))
    return (sup.unionByName(nat) if suppliers else nat).unionByName(reg)


def tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nat = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node"),
                                               F.col("n_name").alias("name"))
    reg = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("node"),
                                               F.col("r_name").alias("name"))
    sup = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("node"), F.col("s_name").alias("name"))
    return sup.unionByName(nat).unionByName(reg)


# ---------------------------------------------------------------- vector stand-ins

EMBED_DIM = 64


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding row is a record whose one original label is its ``label`` (0..9)."""
    emb = read(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"), F.col("label").alias("class_idx"))


def record_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("rvec"))


def class_tree(spark: SparkSession) -> DataFrame:
    """The small class tree over the embedding labels, as a parents table."""
    rows = [(c, [p]) for c, p in CLASS_TREE]
    return spark.createDataFrame(rows, "node long, parents array<long>")


# ---------------------------------------------------------------- item tree, date windows, trained head

# Benchmark items 0..ITEM_ROOTS-1 are roots; the others hang in fours below the items in order.
ITEM_ROOTS, ITEM_FANOUT = 5, 4
HEAD_HIDDEN, HEAD_EPOCHS, HEAD_STEPS, HEAD_RATE = 16, 4, 4, 0.5
HEAD_SCALE = 8.0  # vectors times the root of their length: entries near one


def item_parent(item: F.Column) -> F.Column:
    up = F.floor((item - ITEM_ROOTS) / ITEM_FANOUT).cast("long")
    return F.when(item < ITEM_ROOTS, F.lit(-1).cast("long")).otherwise(up)


def date_windows(customers: DataFrame) -> DataFrame:
    """A window per customer, 1 to 400 days long, overlapping over ten years: ``(window_id, lo, hi, priority)``."""
    key = F.col("c_custkey")
    lo = F.lit("1992-01-01").cast("timestamp") + F.make_dt_interval((key * 7 % 3650).cast("int"), (key % 24).cast("int"))
    hi = lo + F.make_dt_interval((1 + key * 13 % 400).cast("int"))
    return customers.select(key.alias("window_id"), lo.alias("lo"), hi.alias("hi"), (key * 31 % 97).alias("priority"))


def ladder_parents(parts: DataFrame) -> DataFrame:
    """A ladder from the parts: a node per (size band of five, brand, type), below all nodes of the next lower band that occurs; path
    counts multiply from band to band. ``(node, parents)``."""
    from pyspark.sql import Window
    nodes = parts.select(F.floor(F.col("p_size") / 5).cast("long").alias("band"),
                         F.concat_ws(" ", "p_brand", "p_type").alias("kind")).distinct()
    ranks = nodes.select("band").distinct().withColumn("rung", F.row_number().over(Window.orderBy("band")).cast("long"))
    kinds = nodes.select("kind").distinct().withColumn("at", F.row_number().over(Window.orderBy("kind")).cast("long"))
    nodes = nodes.join(ranks, "band").join(kinds, "kind").select("rung", (F.col("rung") * 1000 + F.col("at")).alias("node"))
    rungs = nodes.groupBy((F.col("rung") + 1).alias("rung")).agg(F.sort_array(F.collect_list("node")).alias("up"))
    return nodes.join(rungs, "rung", "left").select("node", F.coalesce("up", F.array(F.lit(-1).cast("long"))).alias("parents"))
