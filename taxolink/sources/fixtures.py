"""Built-in tiny dataset (S12): 13 record texts and 4 class texts, 4 classes.

Texts are invented; labels, masks and the hierarchy follow the reference's inline
example: classes 0..3, class 0 is a child of class 1, classes 1, 2, 3 are roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the tiny dataset: (row_id, class, is_train) for the 13 records.
RECORD_ROWS = (
    (0, 0, True), (1, 0, True), (2, 2, True), (3, 2, True), (4, 0, False),
    (5, 1, False), (6, 1, False), (7, 1, True), (8, 1, True),
    (9, 3, False), (10, 3, False), (11, 3, True), (12, 3, True),
)
CLASS_PARENTS = ((0, [1]), (1, [-1]), (2, [-1]), (3, [-1]))


def dummy_dataset(spark: SparkSession) -> dict[str, DataFrame]:
    """Tables ``rows`` (row_id, text, row_kind, is_train, is_val, is_test, is_class),
    ``labels`` (row_id, class_idx) and ``parents`` (node, parents)."""
    rows = [(r, f"record text {r}", "record", tr, True, True, False) for r, _c, tr in RECORD_ROWS]
    rows += [(13 + c, f"class text {c}", "class", False, False, False, True) for c in range(4)]
    labels = [(r, c) for r, c, _t in RECORD_ROWS] + [(13 + c, c) for c in range(4)]
    schema = "row_id long, text string, row_kind string, is_train boolean, is_val boolean, is_test boolean, is_class boolean"
    return {
        "rows": spark.createDataFrame(rows, schema),
        "labels": spark.createDataFrame(labels, "row_id long, class_idx int"),
        "parents": spark.createDataFrame([(n, p) for n, p in CLASS_PARENTS], "node long, parents array<long>"),
    }
