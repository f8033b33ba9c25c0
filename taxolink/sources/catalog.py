"""Class catalogues as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of catalogue B that the engine uses (the file has more; a trailing comma per row
# adds one unnamed column, which is ignored).
CATALOG_B_COLUMNS = ("CWE-ID", "Name", "Description", "Extended Description",
                     "Common Consequences", "Related Weaknesses")


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None,
             encoding: str = "ISO-8859-1", multi_line: bool = True) -> DataFrame:
    """Header, comma, quoted fields with doubled quotes and line breaks.
    Without ``schema`` every column is a string named by the header (no inference pass). A file with line breaks inside
    fields cannot be split; ``multi_line=False`` reads files without them in splits."""
    r = (spark.read.option("header", True).option("encoding", encoding)
              .option("multiLine", multi_line).option("escape", '"').option("quote", '"'))
    return r.schema(schema).csv(path) if schema is not None else r.csv(path)


def catalog_b(raw: DataFrame) -> DataFrame:
    """Keep the catalogue-B columns by name, numeric id as int."""
    return raw.select(F.col("`CWE-ID`").try_cast("int").alias("CWE-ID"),
                      *[F.col(f"`{c}`") for c in CATALOG_B_COLUMNS[1:]])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """Header, no index; array / map / struct columns are written as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    (df.select(*cols).write.mode(mode).option("header", True).option("escape", '"')
     .option("encoding", encoding).csv(path))
