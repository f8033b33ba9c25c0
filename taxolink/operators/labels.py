"""Label operators.

Labels are kept as a long table ``(row_id, class_idx)``: at 100 TB a dense
records × classes matrix does not exist anywhere; array or vector forms are
built per row only at the edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_index(catalog: DataFrame, name_col: str, order_col: str,
                drop_names: tuple[str, ...] = ()) -> DataFrame:
    """Dense ``class_idx`` 0..n-1 in catalogue order, one row per name.

    ``drop_names`` (the sentinel rows) are removed first. A name listed twice keeps
    its first catalogue position. The catalogue is the small side (hundreds to a
    few thousand classes), so the un-partitioned window runs on that table only.
    """
    cat = catalog
    if drop_names:
        cat = cat.filter(~F.col(name_col).isin(*drop_names))
    firsts = cat.groupBy(name_col).agg(F.min(order_col).alias("_pos"))
    w = Window.orderBy("_pos", name_col)
    return (firsts.withColumn("class_idx", (F.row_number().over(w) - 1).cast("int"))
                  .select(F.col(name_col).alias("class_name"), "class_idx", "_pos")
                  .drop("_pos"))


def explode_codes(df: DataFrame, id_col: str, codes_col: str, out_col: str = "code") -> DataFrame:
    """Array of raw label codes → long ``(id, code)``, duplicates removed."""
    return (df.select(id_col, F.explode(codes_col).alias(out_col))
              .dropDuplicates([id_col, out_col]))


def encode_labels(codes: DataFrame, classes: DataFrame, id_col: str = "row_id",
                  code_col: str = "code") -> DataFrame:
    """L3: keep codes that are catalogue classes → ``(row_id, class_idx)``; unknown codes are ignored."""
    cls = classes.select(F.col("class_name").alias(code_col), "class_idx")
    return (codes.join(cls, code_col, "inner")
                 .select(F.col(id_col).alias("row_id"), "class_idx")
                 .dropDuplicates(["row_id", "class_idx"]))


def has_label(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Rows that carry at least one known label (left semi join)."""
    return rows.join(labels.select(F.col("row_id").alias(id_col)), id_col, "left_semi")


def class_row_labels(classes: DataFrame) -> DataFrame:
    """Every class row is labelled with itself."""
    return classes.select(F.col("class_idx").cast("long").alias("row_id"), "class_idx")


def decode_labels(labels: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Per row the sorted list of its class indices (a row has at most #classes labels)."""
    return labels.groupBy(id_col).agg(F.sort_array(F.collect_list("class_idx")).alias("class_list"))


def class_summary(labels: DataFrame) -> DataFrame:
    """Per class the member count and first / last member id. (The class → members form of L7 is the
    long label table itself: a class may hold a third of all rows, so members are never one list.)"""
    return labels.groupBy("class_idx").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("row_id").alias("min_row"),
        F.max("row_id").alias("max_row"))


def member_words(labels: DataFrame) -> DataFrame:
    """Member sets as sparse bitmaps, ``(class_idx, word, bits)``: bit ``row_id % 64`` of word ``row_id / 64`` (rounded down).

    Built by a partial + final ``bit_or``: up to 64 members in a row, no list per class, repeated labels are harmless. A
    hot class is spread over its words.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row_id").bitwiseAND(F.lit(63)).cast("int"))
    return (labels.groupBy("class_idx", F.shiftright("row_id", 6).alias("word")).agg(F.bit_or(bit).alias("bits")))


def class_overlap(words: DataFrame) -> DataFrame:
    """U4, U5, J8 on member sets: ``(class_a, class_b, n_a, n_b, n_both, n_either, n_only_a)`` for all pairs of classes with a member
    in common, counted on bits; a word meets at most the classes of 64 rows."""
    sizes = words.groupBy("class_idx").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))
    a = words.select(F.col("class_idx").alias("class_a"), "word", F.col("bits").alias("bits_a"))
    b = words.select(F.col("class_idx").alias("class_b"), "word", F.col("bits").alias("bits_b"))
    both = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))
    pairs = (a.join(b, "word").filter("class_a < class_b").groupBy("class_a", "class_b")
             .agg(F.sum(both).cast("long").alias("n_both")).filter("n_both > 0"))
    out = (pairs.join(sizes.select(F.col("class_idx").alias("class_a"), F.col("n").alias("n_a")), "class_a")
           .join(sizes.select(F.col("class_idx").alias("class_b"), F.col("n").alias("n_b")), "class_b"))
    return out.select("class_a", "class_b", "n_a", "n_b", "n_both", (F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("n_either"),
                      (F.col("n_a") - F.col("n_both")).alias("n_only_a"))
