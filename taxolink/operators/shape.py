"""Projection and reshaping helpers.

Plain drops, renames and selections are the DataFrame API itself; the helpers
here carry a rule of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolink.functions.text import concat_with_nan


def move_first(df: DataFrame, *cols: str) -> DataFrame:
    """Put ``cols`` first, keep the rest in order."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*cols, *rest)


def class_text(name: str, *fields: str) -> Column:
    """Class text = name and fields joined by a space, a null field printed as ``nan``."""
    return concat_with_nan(name, *fields)


def first_match_text(catalog: DataFrame, id_col: str, text_col: str, pos_col: str) -> DataFrame:
    """Per id the text of its first catalogue row (lowest position)."""
    return catalog.groupBy(id_col).agg(F.min_by(text_col, pos_col).alias(text_col))


def append_class_rows(records: DataFrame, class_rows: DataFrame) -> DataFrame:
    """Class rows after records; missing columns are null, ``is_class`` marks them."""
    r = records.withColumn("is_class", F.lit(False))
    c = class_rows.withColumn("is_class", F.lit(True))
    return r.unionByName(c, allowMissingColumns=True)


def _apply(col: Column, dtype: T.DataType, fn: Callable[[Column], Column], leaf_types) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _apply(x, dtype.elementType, fn, leaf_types))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _k, v: _apply(v, dtype.valueType, fn, leaf_types))
    if leaf_types is None or isinstance(dtype, leaf_types):
        return fn(col)
    return col


def apply_columns(df: DataFrame, fn: Callable[[Column], Column], cols: Sequence[str] | None = None,
                  leaf_types: tuple | None = None) -> DataFrame:
    """Apply ``fn`` to all or the given columns, recursing into arrays and map values;
    with ``leaf_types`` only values of those types are changed, others left alone."""
    names = list(cols) if cols is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: _apply(F.col(c), types[c], fn, leaf_types) for c in names})


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``(tbl, col, type, n_rows, n_nonnull)`` – one aggregation per table, unpivoted."""
    out = None
    for name, df in tables.items():
        fields = df.schema.fields
        agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
        stacked = agg.select("n_rows", F.explode(F.array(*[
            F.struct(F.lit(f.name).alias("col"), F.lit(f.dataType.simpleString()).alias("type"),
                     F.col(f"c{i}").alias("n_nonnull")) for i, f in enumerate(fields)])).alias("s"))
        part = stacked.select(F.lit(name).alias("tbl"), "s.col", "s.type", "n_rows", "s.n_nonnull")
        out = part if out is None else out.unionByName(part)
    return out
