"""Dataset variants as one bundle: rows with masks, labels and the class hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolink.operators import labels as L
from taxolink.operators import shape as SH
from taxolink.operators import splits as SP
from taxolink.operators import taxonomy as H
from taxolink.operators.ranking import exact_row_number
from taxolink.session import write_and_read


def hierarchy_parts(parents: DataFrame) -> dict[str, DataFrame]:
    """H6 / H7: all forms of a hierarchy from its ``(node, parents)`` table, computed from a catalogue or supplied.

    ``edges (child, parent)`` and ``edges_indexed (form, src, pos, dst)`` in ids and dense indexes, ``node_index (node, class_idx)``,
    ``depths (node, depth, n_paths, ...)``, ``levels (depth, node)``, ``ancestors (node, ancestor)``.
    """
    parents = write_and_read(parents, "variant-parents")
    index = exact_row_number(parents.select("node"), [], ["node"], out_col="_rn")
    index = write_and_read(index.select("node", (F.col("_rn") - 1).alias("class_idx")), "variant-index")
    depths = H.depth_paths(parents)
    return {"edges": H.edges_of(parents), "edges_indexed": H.index_edges(parents, index), "node_index": index,
            "depths": depths, "levels": H.levels(depths), "ancestors": H.ancestors(parents)}


def variant_rows(records: DataFrame, masks: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Records with the masks of a variant, class rows after them.

    ``records`` and ``class_rows`` hold ``row_id`` and any columns; a record that ``masks`` does not list is in no mask, and
    neither is a class row, which ``is_class`` marks (ids of records and classes are apart: ``row_kind``).
    """
    recs = SP.reset_masks(records, masks, "row_id").withColumn("row_kind", F.lit("record"))
    classes = class_rows.withColumns({m: F.lit(False) for m in SP.MASKS}).withColumn("row_kind", F.lit("class"))
    return SH.append_class_rows(recs, classes)


def variant_labels(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``(row_kind, row_id, class_idx)``: the labels of records, then every class row with itself."""
    of_records = labels.select(F.lit("record").alias("row_kind"), F.col("row_id").cast("long"), F.col("class_idx").cast("long"))
    own = L.class_row_labels(classes)
    return of_records.unionByName(own.select(F.lit("class").alias("row_kind"), "row_id", F.col("class_idx").cast("long")))


def variant_bundle(variant: str, records: DataFrame, labels: DataFrame, classes: DataFrame, class_rows: DataFrame,
                   parents: DataFrame, windows: dict[str, tuple[int, int]], ts_col: str = "ts", **split) -> dict[str, DataFrame]:
    """Every part of the chosen variant, by one call: ``rows``, ``labels``, ``classes`` and the hierarchy's parts.

    ``temporal`` and ``random`` differ in the masks only (``split``: seed and fractions of :func:`splits.dataset_variant`).
    The label table is written once, as the masks and the bundle both read it.
    """
    labels = write_and_read(labels, "variant-labels")
    masks = SP.dataset_variant(variant, records, labels, windows, ts_col, **split)
    return {"rows": variant_rows(records, masks, class_rows), "labels": variant_labels(labels, classes),
            "classes": classes, **hierarchy_parts(parents)}
