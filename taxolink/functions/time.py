"""Zoned time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400 * 1_000_000


def zoned_year_start(year, tz: str = "US/Eastern") -> Column:
    """the instant of Jan 1, 00:00 of ``year`` in zone ``tz``."""
    y = F.lit(year) if isinstance(year, int) else year
    return F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(tz))


def after_days(ts, days: int) -> Column:
    """``ts`` plus ``days`` × 24 h of elapsed time (independent of the session zone)."""
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(days * _MICROS_PER_DAY))


def parse_zoned_ts(col, fmt: str = "yyyy-MM-dd'T'HH:mmX") -> Column:
    """Parse a zone-suffixed timestamp string; bad input gives null instead of an error."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c, F.lit(fmt))
