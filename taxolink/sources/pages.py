"""Web-page catalogue (S5): rows of the first list or table of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_block_rows(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
                     container: str = "table", row: str = "tr") -> DataFrame:
    """``(page_id, pos, item)`` for the rows of the **first** ``container`` of each page;
    tags are stripped from each row and surrounding blanks trimmed. Pages are independent,
    so this is a per-row expression over the page table (no shuffle)."""
    block = F.regexp_extract(F.col(html_col), rf"(?s)<{container}[^>]*>(.*?)</{container}>", 1)
    rows = F.regexp_extract_all(block, F.lit(rf"(?s)<{row}[^>]*>(.*?)</{row}>"), 1)
    ex = pages.select(id_col, F.posexplode(rows).alias("pos", "_raw"))
    return ex.select(id_col, "pos", F.trim(decode_entities(F.regexp_replace("_raw", "<[^>]+>", ""))).alias("item"))


# The character entities decoded in cell text (``&amp;`` last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(col):
    """Decode the common HTML character entities of cell text."""
    out = col
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out
