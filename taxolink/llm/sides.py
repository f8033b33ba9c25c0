"""Join sides that are broadcast behind a check of their size, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many rows of 16 bytes (32 MB) are sent to all executors.
BROADCAST_ROWS = 1 << 21
#: A bitmap of 32,768 ids with its key, in such rows.
BITMAP_ROWS = 257


def checked_side(ids: DataFrame, weight: Column | int = 1) -> DataFrame:
    """A written table of ids as a join side: broadcast up to the bound, so that the texts it meets need no shuffle.

    ``weight`` is a row's size in units of 16 bytes.
    """
    return F.broadcast(ids) if (ids.agg(F.sum(F.lit(weight))).first()[0] or 0) <= BROADCAST_ROWS else ids


def rows_with_ids(rows: DataFrame, id_col: str, ids: DataFrame, nulls: bool = False) -> DataFrame:
    """The ``rows`` whose id is in the one column of the written table ``ids``; with ``nulls`` those without an id too.

    The ids go to the rows as bitmaps of 32,768 consecutive ids each, so that the rows, with their texts, stay where they are:
    32 MB hold 268 million ids that lie close together. Ids too far apart for that are sent as a list; where the smaller of the
    two is above the bound, the list is joined by a shuffle.
    """
    wanted, own = F.col(ids.columns[0]).cast("long"), rows[id_col].cast("long")
    ids = ids.select(wanted.alias("_side_id")).filter("_side_id is not null")
    bucket = F.bitmap_bucket_number("_side_id")
    n, buckets = ids.agg(F.count(F.lit(1)), F.count_distinct(bucket)).first()
    keep_null = own.isNull() if nulls else F.lit(False)
    if BITMAP_ROWS * buckets > min(n, BROADCAST_ROWS):
        side = ids.distinct()
        side = F.broadcast(side) if n <= BROADCAST_ROWS else side
        return (rows.join(side, own == side["_side_id"], "left")
                .filter(side["_side_id"].isNotNull() | keep_null).select(*[rows[c] for c in rows.columns]))
    side = F.broadcast(ids.groupBy(bucket.alias("_side_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_side_id")).alias("_side_bits")))
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("_side_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return (rows.join(side, F.bitmap_bucket_number(own) == side["_side_bucket"], "left")
            .filter(held | keep_null).select(*[rows[c] for c in rows.columns]))
