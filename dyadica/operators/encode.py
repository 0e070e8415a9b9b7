"""Feature encoding: column kinds, min-max scaling, category codes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dyadica.functions.distances import CATEGORICAL, NUMERIC, nan_as_null
from dyadica.operators.index import global_position
from dyadica.operators.lookup import join_dictionary

_CATEGORICAL_TYPES = (
    T.StringType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)


@dataclass(frozen=True)
class Feature:
    column: str
    kind: str


@dataclass(frozen=True)
class Scaling:
    low: float
    scale: float


def classify(
    schema: T.StructType, columns: Sequence[str], categorical: Sequence[str] = ()
) -> list[Feature]:
    """Numbers are numeric; strings, booleans, dates and timestamps are categorical.

    ``categorical`` names columns to treat as categories whatever their type.
    """
    missing = [c for c in (*columns, *categorical) if c not in schema.names]
    if missing:
        raise ValueError(f"feature columns not found: {missing}")
    out = []
    for name in columns:
        dtype = schema[name].dataType
        if name in categorical:
            kind = CATEGORICAL
        elif isinstance(dtype, T.NumericType):
            kind = NUMERIC
        elif isinstance(dtype, _CATEGORICAL_TYPES):
            kind = CATEGORICAL
        else:
            raise TypeError(f"feature {name!r} has unsupported type {dtype.simpleString()}")
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"feature {name!r} has unsupported type {dtype.simpleString()}")
        out.append(Feature(name, kind))
    return out


def category(df: DataFrame, feature: Feature) -> Column:
    """The raw category; NaN in a floating column means missing."""
    col = F.col(feature.column)
    if isinstance(df.schema[feature.column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def scaling_bounds(
    df: DataFrame, features: Sequence[Feature], strict: bool = False
) -> dict[str, Scaling]:
    """Min and max of every numeric feature in one pass over those columns.

    A constant column gets scale 1, so it becomes all 0. An infinite bound gets scale 0,
    which turns infinite values into missing; ``strict`` raises instead.
    """
    numeric = [f.column for f in features if f.kind == NUMERIC]
    if not numeric:
        return {}
    aggs = []
    for k, name in enumerate(numeric):
        v = nan_as_null(F.col(name))
        aggs += [F.min(v).alias(f"lo{k}"), F.max(v).alias(f"hi{k}")]
    row = df.agg(*aggs).first()
    out = {}
    for k, name in enumerate(numeric):
        lo, hi = row[f"lo{k}"], row[f"hi{k}"]
        if lo is None:
            lo = hi = 0.0
        if strict and (math.isinf(lo) or math.isinf(hi)):
            raise ValueError(f"feature {name!r} holds infinite values")
        out[name] = Scaling(lo, 1.0 / (hi - lo) if hi > lo else 1.0)
    return out


def scaled(feature: str, bounds: Mapping[str, Scaling]) -> Column:
    b = bounds[feature]
    return nan_as_null((F.col(feature).cast("double") - F.lit(b.low)) * F.lit(b.scale))


def pair_values(
    df: DataFrame, features: Sequence[Feature], bounds: Mapping[str, Scaling], scale: bool = True
) -> list[Column]:
    """Values for pair distances. Only equality of categories matters, so they stay raw."""
    out = []
    for f in features:
        if f.kind == CATEGORICAL:
            out.append(category(df, f))
        elif scale:
            out.append(scaled(f.column, bounds))
        else:
            out.append(F.col(f.column).cast("double"))
    return out


def category_codes(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Dictionary (value, used, code) with 0-based codes in sorted order of the values.

    Counting before the range shuffle combines on the map side, so a value held by a third
    of the rows is one row by then.
    """
    feature = Feature(column, CATEGORICAL)
    counts = (
        df.select(category(df, feature).alias(column))
        .filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("used"))
    )
    return global_position(counts, [column], "code")


def encode_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its category code; missing categories stay NULL."""
    out = df
    for name in columns:
        dictionary, n_values = category_codes(df, name)
        dictionary = dictionary.withColumnRenamed("code", "_code")
        out = join_dictionary(out, dictionary, name, "used", n_values)
        out = out.withColumn(name, F.col("_code").cast("double")).drop("_code")
    return out


def encode_table(
    df: DataFrame,
    columns: Sequence[str],
    categorical: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Encode the feature columns as doubles and keep all other columns."""
    feats = classify(df.schema, columns, categorical)
    bounds = scaling_bounds(df, feats, strict)
    coded = encode_codes(df, [f.column for f in feats if f.kind == CATEGORICAL])
    return coded.select(
        *[
            scaled(c, bounds).alias(c) if c in bounds else F.col(c)
            for c in df.columns
        ]
    )
