"""Dense global positions without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dyadica.session import materialize, shuffle_partitions

# Fixed value: monotonically_increasing_id keeps the row number in the low 33 bits.
ROW_BITS = 33


def global_position(
    df: DataFrame, order: Sequence[str], name: str = "pos", unique: bool = False,
    carry: Sequence[str] = (),
) -> tuple[DataFrame, int]:
    """Number the rows of ``df`` 0..n-1 in ``order``; returns the frame and n.

    One range shuffle sorts the rows over all partitions. The sorted rows are written once,
    so that counting the partitions and numbering them see the same partitions, also when an
    executor is lost. Only one count per partition reaches the driver.

    With ``unique`` the order columns must not repeat, and are all columns of ``df`` but for
    those to ``carry`` along; the range shuffle already brings equal rows together, so the check
    adds no shuffle.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    ranged = df.repartitionByRange(parts, *order)
    if unique:
        carried = [F.first(c).alias(c) for c in carry]
        ranged = ranged.groupBy(*order).agg(F.count(F.lit(1)).alias("_copies"), *carried)
    else:
        ranged = ranged.withColumn("_copies", F.lit(1).cast("bigint"))
    ranged = ranged.sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("_slot", F.monotonically_increasing_id()), tidy=True)
    part = F.shiftright("_slot", ROW_BITS).cast("int")
    per_part = stored.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.max("_copies").alias("copies")
    )
    counts = {}
    for row in per_part.collect():
        counts[row["part"]] = row["n"]
        if row["copies"] > 1:
            raise ValueError(f"{list(order)} do not tell the rows apart")
    offsets, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    table = F.expr("array(" + ",".join(f"{o}L" for o in offsets or [0]) + ")")
    local = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = stored.withColumn(name, F.element_at(table, part + 1) + local)
    return placed.drop("_slot", "_copies"), total
