"""Column helpers built from pyspark.sql.functions only (JVM side, codegen friendly)."""

from taxolink.functions.arrays import (abs_diff_and_product, as_list, cyclic_repeat,
                                       joined_sorted, sorted_int_list_text)
from taxolink.functions.keys import hash_u32, hash_unit, order_key
from taxolink.functions.mathx import argmax2, floor_frac, softmax2_p1, threshold
from taxolink.functions.text import (concat_with_nan, contains_marker, first_int,
                                     parse_list_text, relation_ids, truncate_text)
from taxolink.functions.time import after_days, parse_zoned_ts, zoned_year_start

__all__ = [
    "abs_diff_and_product", "as_list", "cyclic_repeat", "joined_sorted",
    "sorted_int_list_text", "hash_u32", "hash_unit", "order_key", "argmax2",
    "floor_frac", "softmax2_p1", "threshold", "concat_with_nan", "contains_marker",
    "first_int", "parse_list_text", "relation_ids", "truncate_text", "after_days",
    "parse_zoned_ts", "zoned_year_start",
]
