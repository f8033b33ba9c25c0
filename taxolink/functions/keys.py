"""Reproducible pseudo-random keys.

Every random choice in the engine (shuffles, samples, masks) orders or draws by
an md5 over ``seed#key…``. The same string hash exists in DuckDB, so sampling
queries stay checkable against SQL, and a rerun after a lost executor draws the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(seed, cols) -> list[Column]:
    out = [F.lit(str(seed))]
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out.append(c.cast("string"))
    return out


def order_key(seed, *cols) -> Column:
    """md5 hex of ``seed#c1#c2…``: a sort key that shuffles rows reproducibly."""
    return F.md5(F.concat_ws("#", *_parts(seed, cols)))


def hash_u32(seed, *cols) -> Column:
    """First 8 hex digits of :func:`order_key` as an integer in [0, 2**32)."""
    return F.conv(F.substring(order_key(seed, *cols), 1, 8), 16, 10).cast("long")


def hash_unit(seed, *cols) -> Column:
    """:func:`hash_u32` scaled to a double in [0, 1)."""
    return hash_u32(seed, *cols).cast("double") / F.lit(4294967296.0)
