"""Array helpers (F8, F11, F16, output formatting)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(col) -> Column:
    """Wrap a scalar into a one-element list."""
    return F.array(_c(col))


def cyclic_repeat(arr, k: int) -> Column:
    """F16: repeat a list cyclically to exactly ``k`` items (null for an empty list).

    Built from ``array_repeat`` + ``flatten`` + ``slice`` rather than a per-element lambda
    that indexes ``arr``: when the optimizer inlines an expensive ``arr`` expression (e.g.
    through the filter it infers in front of an explode) it is then evaluated a constant
    number of times per row, not k times.
    """
    a = _c(arr)
    n = F.size(a)
    reps = (F.lit(k) / n).cast("int") + 1
    return F.when(n > 0, F.slice(F.flatten(F.array_repeat(a, reps)), 1, k))


def abs_diff_and_product(a, b) -> Column:
    """``[|a-b| ; a*b]``, length 2d."""
    a, b = _c(a), _c(b)
    return F.concat(F.zip_with(a, b, lambda x, y: F.abs(x - y)),
                    F.zip_with(a, b, lambda x, y: x * y))


def sorted_int_list_text(arr, sep: str = ",") -> Column:
    """Integers sorted numerically, then joined: a stable text form for comparisons."""
    return F.array_join(F.transform(F.sort_array(_c(arr)), lambda x: x.cast("string")), sep)


def joined_sorted(arr, sep: str = "|") -> Column:
    """Strings sorted, then joined."""
    return F.array_join(F.sort_array(_c(arr)), sep)
