"""Ordinal, average and soft ranks within batches of pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dyadica.functions.hashing import HEX_BASE, HEX_DIGITS, hash48
from dyadica.operators.index import ROW_BITS, global_position
from dyadica.operators.lookup import join_dictionary
from dyadica.session import group_rows, materialize, shuffle_partitions

ORDINAL = "ordinal"
AVERAGE = "average"


def rank_value(col: Column, digits: int | None = None) -> Column:
    """The value ranks compare.

    Sums that are equal on paper differ in the last bit of a double, which would split true
    ties. Single precision makes them equal again whatever their size; ``digits`` rounds to
    decimals instead. Adding 0 makes -0 equal 0.
    """
    if digits is None:
        return col.cast("float") + F.lit(0.0).cast("float")
    return F.round(col, digits) + F.lit(0.0)


def ordinal_position(
    df: DataFrame, group: str, order: Sequence[str], name: str, rows_per_group: int
) -> DataFrame:
    """0-based position within ``group`` in ``order``, whose last column breaks ties.

    Batches up to the configured size are sorted by one window task each. Larger batches are
    sorted over all partitions at once and numbered by group start. Groups must be numbered
    0..g-1 and hold exactly ``rows_per_group`` rows.
    """
    if rows_per_group <= group_rows(df.sparkSession):
        w = Window.partitionBy(group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint") - 1)
    placed, _ = global_position(df, [group, *order], "_pos")
    start = F.col(group).cast("bigint") * F.lit(rows_per_group).cast("bigint")
    return placed.withColumn(name, F.col("_pos") - start).drop("_pos")


def average_rank(
    df: DataFrame, group: str, value: str, tie: str, name: str, rows_per_group: int
) -> DataFrame:
    """0-based rank within ``group`` where equal values share the mean of their positions."""
    if rows_per_group <= group_rows(df.sparkSession):
        w = Window.partitionBy(group).orderBy(value)
        same = Window.partitionBy(group, value)
        lowest = F.rank().over(w).cast("double") - 1
        shared = F.count(F.lit(1)).over(same).cast("double")
        return df.withColumn(name, lowest + (shared - 1) / 2)
    placed = ordinal_position(df, group, [value, tie], "_ord", rows_per_group)
    placed = placed.withColumn("_key", F.concat_ws(":", F.col(group), F.hex(F.col(value).cast("string"))))
    means = placed.groupBy("_key").agg(
        F.avg("_ord").alias(name), F.count(F.lit(1)).alias("_used")
    )
    joined = join_dictionary(placed, means, "_key", "_used", means.count())
    return joined.drop("_key", "_ord")


def rank_by(
    df: DataFrame, group: str, value: str, tie: str, name: str, rows_per_group: int, ties: str
) -> DataFrame:
    if ties == ORDINAL:
        return ordinal_position(df, group, [value, tie], name, rows_per_group)
    if ties == AVERAGE:
        return average_rank(df, group, value, tie, name, rows_per_group)
    raise ValueError(f"unknown tie rule: {ties}")


def shuffle_within(
    df: DataFrame, group: str, value: str, stream: str, name: str, rows_per_group: int
) -> DataFrame:
    """A random permutation of ``value`` within every batch.

    ``pair_id`` must number the batches' rows consecutively. Each row offers its value to the
    slot given by its place in a random order and takes the value offered to its own slot.
    Both records of a slot meet within the batch, so no second shuffle is needed when the
    batch is one window group.
    """
    hashed = df.withColumn("_h", hash48(f"{stream}:p:", F.col("pair_id")))
    placed = ordinal_position(hashed, group, ["_h", "pair_id"], "_to", rows_per_group)
    own_slot = F.expr(f"pair_id % {rows_per_group}")
    rest = [c for c in df.columns if c != group]
    own = [own_slot.alias("_slot"), F.lit(False).alias("_offer"), F.col(value).alias("_v")]
    offer = [F.col("_to").alias("_slot"), F.lit(True).alias("_offer"), F.col(value).alias("_v")]
    empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest]
    records = F.inline(F.array(F.struct(*own, *rest), F.struct(*offer, *empty)))
    w = Window.partitionBy(group, "_slot").orderBy("_offer")
    return (
        placed.select(group, records)
        .withColumn(name, F.lead("_v").over(w))
        .filter(~F.col("_offer"))
        .select(*df.columns, name)
    )


# ------------------------------------------- batches beyond one task, without positions


def shuffle_within_large(df: DataFrame, group: str, value: str, stream: str, name: str, rows_per_group: int) -> DataFrame:
    """``shuffle_within`` of a stored table whose batches exceed one task.

    The numbers that order a batch are uniform, so equal stretches of their range hold about
    equally many rows: one aggregate counts these, and a window task numbers the rows of each.
    """
    stretches = max(1, -(-2 * rows_per_group // max(1, group_rows(df.sparkSession))))
    hashed = df.select(group, "pair_id", F.col(value).alias("_v"), hash48(f"{stream}:p:", F.col("pair_id")).alias("_h"))
    hashed = hashed.withColumn("_at", F.expr(f"cast(_h * {stretches} div {HEX_BASE ** HEX_DIGITS} as int)"))
    before = Window.partitionBy(group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(group, "_at").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(group, "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(group, "_at").orderBy("_h", "pair_id")
    placed = hashed.withColumn("_place", F.row_number().over(w) - 1).join(F.broadcast(starts), [group, "_at"])
    slot = F.col(group).cast("bigint") * F.lit(rows_per_group).cast("bigint") + F.col("_start") + F.col("_place")
    offers = placed.select(slot.alias("_slot"), F.col("_v").alias(name))
    return df.join(offers, F.col("pair_id") == F.col("_slot"), "left").select(*df.columns, name)


def _sorted_slots(df: DataFrame, order: Sequence[str], name: str, parts: int) -> DataFrame:
    """Rows sorted over all partitions, with their partition and place in it as one number."""
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.withColumn(name, F.monotonically_increasing_id())


def rank_correlations(
    df: DataFrame, group: str, first: str, others: Sequence[str], tie: str, rows: int
) -> DataFrame:
    """Correlation of the ordinal ranks of ``first`` with those of each of ``others`` within every
    batch: (group, n, others...), for batches of any size.

    Rows are sorted over all partitions by ``first`` and then by the others, all of them at once.
    A rank is the start of its partition plus the place there, so counts and sums of places by the
    pairs of partitions suffice; the starts come from these counts, and no position is written.
    """
    from dyadica.operators.correlation import corr_from_sums

    spark = df.sparkSession
    parts = max(shuffle_partitions(spark), -(-rows // max(1, group_rows(spark))))
    by_first = _sorted_slots(df, [group, first, tie], "_a", parts)
    values = F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_value")) for k, c in enumerate(others)])
    long = by_first.select(group, F.col(tie).alias("_tie"), "_a", F.inline(values))
    found = _sorted_slots(long, [group, "_kind", "_value", "_tie"], "_b", parts * len(others))
    place = {c: F.col(c).bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("double") for c in ("_a", "_b")}
    cells = materialize(
        found.groupBy(group, "_kind", *[F.shiftright(c, ROW_BITS).alias(f"{c}_part") for c in ("_a", "_b")]).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(place["_a"]).alias("_sa"), F.sum(place["_b"]).alias("_sb"),
            F.sum(place["_a"] * place["_b"]).alias("_sab"),
        ),
        tidy=True,
    )

    def starts(table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        """How many rows come before each key; a row a partition or batch."""
        w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        counts = table.groupBy(*keys).agg(F.sum("_n").alias("_c"))
        return F.broadcast(counts.select(*keys, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(name)))

    once = cells.filter("_kind = 0")
    sizes = F.broadcast(once.groupBy(group).agg(F.sum("_n").alias("n")))
    wide = cells.join(sizes, group)
    for c, table, batch in (("_a", once, [group]), ("_b", cells, [group, "_kind"])):
        wide = wide.join(starts(table, [f"{c}_part"], f"{c}_from"), f"{c}_part")
        wide = wide.join(starts(table, batch, f"{c}_batch"), batch)
    # Ranks less their mean, so that the sums of products stay small.
    a, b = ((F.col(f"{c}_from") - F.col(f"{c}_batch")).cast("double") - (F.col("n") - 1) / 2 for c in ("_a", "_b"))
    sab = F.sum(F.col("_n") * a * b + a * F.col("_sb") + b * F.col("_sa") + F.col("_sab"))
    n = F.col("n").cast("double")
    spread = n * (n * n - 1) / 12
    per_kind = wide.groupBy(group, "n", "_kind").agg(sab.alias("_sum"))
    corr = corr_from_sums(F.col("_sum"), spread, spread)
    return per_kind.groupBy(group, "n").agg(
        *[F.max(F.when(F.col("_kind") == k, corr)).alias(c) for k, c in enumerate(others)]
    )


# ------------------------------------------------------------------ soft ranks


def soft_rank_affine(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Soft rank at unit strength while the values of a batch span at most half its size.

    The projection onto the permutahedron is then the shifted values (Blondel et al. 2020).
    The batch mean comes from one aggregate over the values, which are written once, and one row
    a batch is broadcast back, so no batch is gathered in one task. A batch
    outside that span raises; ``soft_rank`` handles it.
    """
    from dyadica.operators.scaling import per_batch

    v = F.col(value)
    df = materialize(df)
    stats = df.groupBy(group).agg(
        F.avg(v).alias("_mean"), F.count(v).alias("_n"), (F.max(v) - F.min(v)).alias("_span")
    )
    bad = F.raise_error(F.lit("values span more than half the batch size")).cast("double")
    soft = F.when(
        F.col("_span") <= F.col("_n") / 2, v - F.col("_mean") + (F.col("_n") + 1) / 2
    ).otherwise(bad)
    return df.join(per_batch(stats), group).select(*df.columns, soft.alias(name))


def pooled(totals, sizes):
    """Neighbouring blocks (total, size) pooled until their means fall strictly; which block each
    result starts with."""
    out, counts, starts = [], [], []
    for k, (t, c) in enumerate(zip(totals, sizes)):
        out.append(t)
        counts.append(c)
        starts.append(k)
        while len(out) > 1 and out[-2] * counts[-1] <= out[-1] * counts[-2]:
            t, c = out.pop(), counts.pop()
            starts.pop()
            out[-1] += t
            counts[-1] += c
    return out, counts, starts


def soft_rank(df: DataFrame, group: str, value: str, tie: str, name: str, rows_per_group: int) -> DataFrame:
    """Soft rank at unit strength for any values: isotonic regression of each batch.

    A batch up to the configured group size is regressed in one task. Larger batches are pooled in
    stretches of that size, and then across the borders of stretches where blocks still violate
    the order, until none does; pooling is right in any order.
    """
    if rows_per_group > group_rows(df.sparkSession):
        return _soft_rank_large(df, group, value, tie, name, rows_per_group)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def project(pdf):
        v = pdf[value].to_numpy(dtype=float)
        order = np.lexsort((pdf[tie].to_numpy(), -v))
        s = v[order]
        target = s - np.arange(len(s), 0, -1, dtype=float)
        totals, sizes, _ = pooled(target.tolist(), [1] * len(s))
        soft = np.empty_like(v)
        soft[order] = s - np.repeat(np.array(totals) / np.array(sizes), sizes)
        return pdf.assign(**{name: soft})

    return df.groupBy(group).applyInPandas(project, schema)


def _soft_rank_large(df: DataFrame, group: str, value: str, tie: str, name: str, rows_per_group: int) -> DataFrame:
    spark, most, names = df.sparkSession, group_rows(df.sparkSession), df.columns
    falling = df.withColumn("_falling", -F.col(value))
    placed = ordinal_position(falling, group, ["_falling", tie], "_place", rows_per_group).drop("_falling")
    placed = materialize(placed.withColumn("_at", F.expr(f"_place div {most}")))
    # Blocks (total, size) by their first position; a stretch has the number of its first one's.
    target = F.col(value) - (F.lit(float(rows_per_group)) - F.col("_place"))
    kind = f"_g {df.schema[group].dataType.simpleString()}, _part long, _start long, _size long, _total double"
    rows = placed.select(
        F.col(group).alias("_g"), (F.col("_at") * most).alias("_part"), F.col("_place").alias("_start"),
        F.lit(1).cast("bigint").alias("_size"), target.alias("_total"),
    )

    def pool(pdf):
        pdf = pdf.sort_values("_start", ignore_index=True)
        totals, sizes, starts = pooled(pdf["_total"].tolist(), pdf["_size"].tolist())
        out = pdf.loc[starts].assign(_size=sizes, _total=totals)
        # Within a stretch no order is violated any more, so it may be cut anywhere.
        first = out["_start"].to_numpy()
        return out.assign(_part=first[np.arange(len(out)) // most * most])

    pool_all = lambda frame: frame.groupBy("_g", "_part").applyInPandas(pool, kind)
    blocks = materialize(pool_all(rows))
    while (joins := _violations(blocks, most)) is not None:
        # One number a stretch: which stretch it is pooled with.
        table = spark.createDataFrame(joins, f"_g {df.schema[group].dataType.simpleString()}, _part long, _with long, _move boolean")
        moved = blocks.join(F.broadcast(table), ["_g", "_part"])
        again = pool_all(moved.filter("_move").select("_g", F.col("_with").alias("_part"), "_start", "_size", "_total"))
        blocks = materialize(moved.filter("not _move").drop("_with", "_move").unionByName(again))
    means = blocks.select(
        F.col("_g").alias(group), F.col("_start"), (F.col("_total") / F.col("_size")).alias("_mean"),
        F.explode(F.sequence(F.expr(f"_start div {most}"), F.expr(f"(_start + _size - 1) div {most}"))).alias("_at"),
    )
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def place(left, right):
        right = right.sort_values("_start")
        found = np.searchsorted(right["_start"].to_numpy(), left["_place"].to_numpy(), side="right") - 1
        return left[names].assign(**{name: left[value].to_numpy(dtype=float) - right["_mean"].to_numpy()[found]})

    key = [group, "_at"]
    return placed.groupBy(*key).cogroup(means.groupBy(*key)).applyInPandas(place, schema)


def _violations(blocks: DataFrame, most: int) -> list[tuple] | None:
    """(group, stretch, stretch to be pooled in, whether it is pooled) of all stretches, where some
    border's blocks violate the order; None where none does. A row a stretch reaches the driver.

    Stretches whose borders violate are pooled together, at least two, up to 2 * ``most`` blocks.
    """
    ends = F.struct("_start", "_total", "_size")
    found = blocks.groupBy("_g", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.min(ends).alias("first"), F.max(ends).alias("last")
    ).collect()
    found.sort(key=lambda r: (str(r["_g"]), r["first"]["_start"]))
    out, pooling, held = [], False, 0
    for k, r in enumerate(found):
        before = found[k - 1] if k and found[k - 1]["_g"] == r["_g"] else None
        bad = False
        if before is not None:
            left, right = before["last"], r["first"]
            bad = left["_total"] * right["_size"] <= right["_total"] * left["_size"]
        alone = bool(out) and out[-1][1] == out[-1][2]
        if bad and (alone or held + r["n"] <= 2 * most):
            pooling, held = True, held + r["n"]
            out[-1] = (*out[-1][:3], True)
            out.append((r["_g"], r["_part"], out[-1][2], True))
        else:
            held = r["n"]
            out.append((r["_g"], r["_part"], r["_part"], False))
    return out if pooling else None
