"""Min-max scaled squared distances per pair, with bounds that only ever widen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from dyadica.functions.distances import minmax_square
from dyadica.session import materialize
from dyadica.sources.sizing import fits_broadcast


def per_batch(table: DataFrame) -> DataFrame:
    """A table of one row a batch, to be joined to pairs: broadcast when measured to fit, since a
    batch would otherwise be one join key."""
    table = materialize(table)
    return F.broadcast(table) if fits_broadcast(table, table.count()) else table


def running_bounds(pairs: DataFrame, step: str = "trial") -> DataFrame:
    """Bounds of all distances up to and including each step: (step, low, high).

    Distances are reduced to one row per step before the running window, so the window sorts
    as many rows as there are steps.
    """
    per_step = pairs.groupBy(step).agg(F.min("d").alias("low"), F.max("d").alias("high"))
    w = Window.partitionBy(F.lit(0)).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return per_step.select(step, F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"))


def minmax_square_distances(pairs: DataFrame, step: str = "trial", name: str = "s") -> DataFrame:
    """Scale every distance by the bounds seen up to its step, then square it."""
    # Written once: the bounds and the distances would each draw and join the pairs anew.
    pairs = materialize(pairs)
    bounds = per_batch(running_bounds(pairs, step))
    scaled = minmax_square(F.col("d"), F.col("low"), F.col("high"))
    return pairs.join(bounds, step).withColumn(name, scaled).drop("low", "high")
