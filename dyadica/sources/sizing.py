"""Measured size of a side, checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dyadica.session import broadcast_bytes

# Bytes of a row's slot in a hash table, which is at most half full, and of its header.
_ROW_OVERHEAD = 72


def _value_bytes(name: str, dtype: T.DataType) -> Column:
    col = F.col(name)
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("bigint") + 8
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.size(col), F.lit(0)).cast("bigint") * 8 + 16
    return F.lit(8).cast("bigint")


def widest_row(df: DataFrame) -> int:
    """Bytes of the widest row."""
    total = sum((_value_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))
    return int(df.agg(F.max(total).alias("b")).first()["b"] or 0)


def fits_broadcast(df: DataFrame, n_rows: int) -> bool:
    """True when the rows of ``df`` are measured to fit the broadcast limit.

    The row count alone settles large tables, so only a table that could fit is scanned.
    """
    limit = broadcast_bytes(df.sparkSession)
    if n_rows * (_ROW_OVERHEAD + 8 * len(df.columns)) > limit:
        return False
    varying = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.ArrayType))]
    if not varying:
        return True
    total = sum((_value_bytes(f.name, f.dataType) for f in varying), F.lit(0).cast("bigint"))
    measured = df.agg(F.sum(total).alias("b")).first()["b"] or 0
    return measured + n_rows * (_ROW_OVERHEAD + 8 * len(df.columns)) <= limit
