"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dyadica.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node it is linked to.

    Each round points every node at its smallest smaller neighbour, follows the pointers to their
    ends by doubling, and keeps the links between different ends. Rounds are few: every node but
    local minima goes away in each. All tables are written, nothing is collected.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    left = materialize(pairs.distinct())
    ends = None
    while not left.isEmpty():
        up = materialize(_ended(materialize(left.groupBy("a").agg(F.min("b").alias("up")))))
        if ends is None:
            both = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
            ends = both.withColumn("root", F.col("node"))
        ends = materialize(_moved(ends, "root", up))
        left = _moved(_moved(left, "a", up), "b", up)
        left = materialize(
            left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        )
    if ends is None:
        kind = links.schema["a"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return ends


def _moved(df: DataFrame, column: str, up: DataFrame) -> DataFrame:
    to = up.select(F.col("a").alias("_at"), F.col("up").alias("_up"))
    joined = df.join(to, F.col(column) == F.col("_at"), "left")
    return joined.withColumn(column, F.coalesce("_up", column)).drop("_at", "_up")


def _ended(up: DataFrame) -> DataFrame:
    """Pointers followed to their ends, by doubling."""
    while True:
        to = up.select(F.col("a").alias("_at"), F.col("up").alias("_up"))
        jumped = up.join(to, F.col("up") == F.col("_at"), "left")
        moved = materialize(jumped.select("a", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("_moved")))
        if moved.filter("_moved").isEmpty():
            return moved.select("a", "up")
        up = moved.select("a", "up")
