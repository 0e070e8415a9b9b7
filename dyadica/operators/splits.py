"""Seeded train/test and fold columns from the id, the same whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dyadica.functions.hashing import draw_bucket

PERCENT = 100


def _key(id: str | Sequence[str]) -> Column:
    """The id as text; a null id counts as empty text, so that its rows fall somewhere too."""
    return F.coalesce(F.col(id).cast("string"), F.lit("")) if isinstance(id, str) else F.concat_ws("|", *id)


def train_test_split(
    df: DataFrame, id: str | Sequence[str] = "id", train_percent: int = 75, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Rows are split, so that pairs are later drawn inside each side."""
    in_train = draw_bucket(f"{seed}:split:", _key(id), PERCENT) < train_percent
    return df.filter(in_train), df.filter(~in_train)


def with_fold(df: DataFrame, k: int, id: str | Sequence[str] = "id", seed: int = 0) -> DataFrame:
    return df.withColumn("fold", draw_bucket(f"{seed}:fold:", _key(id), k).cast("int"))
