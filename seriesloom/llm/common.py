"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..tables import new_path, shared_dir, store

#: What separates words: space, tab and the four ASCII line separators.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Groups (sources, pools) whose state, a few numbers each, the driver holds between steps; the state of more stays in tables and is joined.
HELD = 1_000

__all__ = ["HELD", "ROW_ID", "SPACE", "WORD", "arrow", "count_words", "new_path", "one_per_id", "shared_dir", "store", "utf8_bytes", "with_ids"]


def arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema), on executors that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def count_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: The column of ``with_ids``.
ROW_ID = "seriesloom_row_id"


def with_ids(docs: DataFrame) -> DataFrame:
    """docs with ROW_ID: doc_id, or for each row without one a number that no row has.

    Those numbers are larger than every doc_id, so that a smallest id is a doc_id where there is one; in a table with
    doc_ids of 2^62 and more they are smaller.  The rows are stored if some lack a doc_id, so that the numbers stay.
    """
    own = F.col("doc_id").cast("long")
    if not docs.where(own.isNull()).limit(1).count():
        return docs.withColumn(ROW_ID, own)
    r = docs.agg(F.min(own).alias("least"), F.max(own).alias("most")).first()
    if (r.most or 0) < 1 << 62:
        base = 1 << 62
    elif r.least >= -(1 << 62):
        base = -(1 << 63)
    else:
        raise ValueError("doc_ids leave no room for rows without one")
    return store(docs.withColumn(ROW_ID, F.coalesce(own, F.lit(base).cast("long") + F.monotonically_increasing_id())), "numbered")


def _has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_has_order(f.dataType) for f in kind)
    return not isinstance(kind, T.MapType | T.VariantType | T.CalendarIntervalType)


def one_per_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with one row, the smallest, of the rows that share a key; rows with a null key all stay.

    The keys are counted first, so that a table without repeats isn't shuffled.  Columns without an order (maps) compare as text.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).where(F.col(key).isNotNull())
    if not repeated.limit(1).count():
        return df
    order = F.struct(*[(F.col(f"`{f.name}`") if _has_order(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`")))).alias(f.name) for f in df.schema])
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("row"))
    return least.select("row.*").unionByName(df.where(F.col(key).isNull()))
