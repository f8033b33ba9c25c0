"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_marker(col, marker: str) -> Column:
    """case-sensitive substring test."""
    return _c(col).contains(marker)


def first_int(col) -> Column:
    """first run of digits as an int; null when there is none."""
    return F.regexp_extract(_c(col), r"(\d+)", 1).try_cast("int")


def relation_ids(col, pattern: str = r"ChildOf:CWE ID:(\d+)") -> Column:
    """All ids captured by ``pattern``, distinct in first-seen order, ``[-1]`` if none."""
    ids = F.array_distinct(
        F.transform(F.regexp_extract_all(_c(col), F.lit(pattern), 1), lambda x: x.cast("long")))
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, ids).otherwise(F.array(F.lit(-1).cast("long")))


def parse_list_text(col, strip_items: bool = False) -> Column:
    """A Python-literal list printed as text back to an array of strings.

    ``"['a', 'b']"`` → ``[a, b]``; an unquoted ``"a"`` → ``[a]``; ``"[]"`` → ``[]``.
    Brackets are trimmed, the rest split on the quote character and the separators dropped.
    """
    parts = F.split(F.btrim(_c(col), F.lit("[]")), "'")
    kept = F.filter(parts, lambda x: ~x.isin(",", ", ", ""))
    if strip_items:
        kept = F.filter(F.transform(kept, lambda x: F.trim(x)), lambda x: x != "")
    return kept


def truncate_text(col, n: int = 512) -> Column:
    """Text as string, null printed as ``nan``, cut at ``n`` characters."""
    return F.substring(F.coalesce(_c(col).cast("string"), F.lit("nan")), 1, n)


def concat_with_nan(*cols, sep: str = " ") -> Column:
    """Join fields with ``sep``; a null field prints as ``nan`` (plain concat_ws would skip it)."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("nan")) for c in cols])
