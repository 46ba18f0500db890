"""Joins that broadcast one side only after measuring it in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a side may take to be broadcast, as rows of a hash table. It is small, so that dozens of them fit in any
#: driver, and a plan turns to shuffled joins early: what is measured on little data holds for much.
BROADCAST_BYTES = 1 << 20
#: What a row takes in a broadcast hash table besides its columns: its header, a pointer and its share of empty slots.
ROW_BYTES = 40


def width(field: T.StructField) -> int | Column:
    """Bytes of a column in a row: a number where that is fixed, else an expression."""
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return 2 * F.octet_length(F.to_json(F.struct(c))) + 24
    return 16 if isinstance(kind, T.DecimalType) else 8


def bytes_of(df: DataFrame) -> int:
    """Bytes of all rows of ``df`` in a broadcast hash table. Rows of fixed width are only counted."""
    widths = [width(f) for f in df.schema]
    fixed = ROW_BYTES + sum(w for w in widths if isinstance(w, int))
    varying = [w for w in widths if not isinstance(w, int)]
    if not varying:
        return fixed * df.count()
    n, more = df.agg(F.count("*"), F.sum(sum(varying[1:], varying[0]).cast("long"))).first()
    return fixed * n + (more or 0)


def join_checked(big: DataFrame, few: DataFrame, on: str | list[str] | Column, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``big`` with ``few``, a materialised table: broadcast if it takes at most ``most`` bytes, else a
    shuffled join that the adaptive planner may split where keys are skewed."""
    return big.join(F.broadcast(few) if bytes_of(few) <= most else few, on, how)
