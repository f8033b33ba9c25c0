"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax2_p1(l0, l1) -> Column:
    """probability of class 1 from two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(l0) - _c(l1)))


def argmax2(p0, p1) -> Column:
    """arg-max of two values, a tie goes to index 0."""
    return F.when(_c(p1) > _c(p0), F.lit(1)).otherwise(F.lit(0))


def threshold(p, th: float = 0.5) -> Column:
    """1 when ``p >= th`` else 0."""
    return (_c(p) >= F.lit(float(th))).cast("int")


def floor_frac(cnt, frac: float) -> Column:
    """``int(cnt * frac)`` with a DOUBLE fraction (a decimal literal would round differently)."""
    return F.floor(_c(cnt).cast("double") * F.lit(float(frac))).cast("long")
