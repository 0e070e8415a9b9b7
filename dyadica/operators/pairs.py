"""Seeded pair sampling, and gathering the two sides of each pair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dyadica.functions.hashing import draw_numbers, index_of
from dyadica.session import broadcast_bytes

# Bytes one pair end, or one bare position, takes in a broadcast hash table: up to 64 for its
# slot, which is at most half full, and the rest for its row.
_END_BYTES = 128
_POSITION_BYTES = 80


def draw_ends(pairs: DataFrame, n: int, stream: str) -> DataFrame:
    """Uniform ends in 0..n-1: both orders and self-pairs occur, with replacement."""
    if n <= 0:
        raise ValueError("cannot sample pairs from an empty table")
    drawn = draw_numbers(pairs, stream, "pair_id", "_a", "_b")
    return drawn.select(*pairs.columns, index_of("_a", n).alias("i"), index_of("_b", n).alias("j"))


def sample_pairs(source, batch_size: int, n_trials: int = 1, stream: str = "0") -> DataFrame:
    """``n_trials`` batches of ``batch_size`` pairs of a source: (pair_id, trial, i, j)."""
    return sample_pair_range(source, 0, batch_size * n_trials, batch_size, stream)


def sample_pair_range(
    source, first: int, last: int, batch_size: int, stream: str, partitions: int | None = None
) -> DataFrame:
    """The pairs numbered first..last-1 of a stream of batches."""
    spark = source.df.sparkSession
    ids = spark.range(first, last, 1, partitions).select(
        F.col("id").alias("pair_id"), F.expr(f"id div {batch_size}").alias("trial")
    )
    return source.draw(ids, stream, last - first)


# A pair is measured once and counted where so many draws fall on each of the n*n pairs.
COUNTED_DRAWS = 2
# Up to this many of them, tasks count in a plain array, which beats a hash table by far.
COUNTED_CELLS = 1 << 22


def counted_pairs(source, n_pairs: int, batch_size: int, stream: str) -> DataFrame | None:
    """The first pairs of a stream as (i, j, times): how often each was drawn. None unless they
    were drawn at least COUNTED_DRAWS times each on average."""
    n = source.size()
    if not n or not source.draws_ends() or n_pairs < COUNTED_DRAWS * n * n:
        return None
    if n * n > COUNTED_CELLS:
        drawn = sample_pair_range(source, 0, n_pairs, batch_size, stream)
        cells = drawn.select((F.col("i") * F.lit(n) + F.col("j")).alias("_cell")).groupBy("_cell")
        counts = cells.agg(F.count(F.lit(1)).alias("times"))
        # Never NULL; saying so keeps filters from being pushed below the count.
        i, j = (F.coalesce(c, F.lit(0).cast("bigint")) for c in (F.expr(f"_cell div {n}"), F.col("_cell") % F.lit(n)))
        return counts.select(i.alias("i"), j.alias("j"), "times")
    # Each task counts several draws for each number that it hands on.
    tasks = max(1, min(source.df.sparkSession.sparkContext.defaultParallelism, n_pairs // (4 * n * n)))
    drawn = sample_pair_range(source, 0, n_pairs, batch_size, stream, tasks)
    counts = _summed(_count_cells(drawn.select((F.col("i") * F.lit(n) + F.col("j")).alias("_cell")), n))
    long = counts.select("i", F.posexplode("times").alias("j", "times")).filter("times > 0")
    return long.select("i", F.col("j").cast("bigint").alias("j"), "times")


def _count_cells(cells: DataFrame, n: int) -> DataFrame:
    """A row (i, times) for each i and task: how often each j was drawn with it."""

    def run(batches):
        total = np.zeros(n * n, dtype=np.int64)
        held, size = [], 0
        for batch in batches:
            held.append(np.asarray(batch.column(0)))
            size += batch.num_rows
            if size >= n * n:
                total += np.bincount(np.concatenate(held), minlength=n * n)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=n * n)
        offsets = pa.array(np.arange(0, n * n + 1, n, dtype=np.int32))
        times = pa.ListArray.from_arrays(offsets, pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), times], names=["i", "times"])

    return cells.mapInArrow(run, "i long, times array<long>")


def _summed(rows: DataFrame) -> DataFrame:
    """One row an i, its arrays added up."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, times in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.asarray(times.values)
                sums[i] = sums[i] + found if i in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["i", "times"])

    return rows.repartition("i").mapInArrow(run, "i long, times array<long>")


def sample_prefixes(
    source, sizes: Sequence[int], n_trials: int, stride: int, stream: str
) -> DataFrame:
    """For each trial the pairs of all ``sizes`` at once: (pair_id, trial, step, i, j).

    ``step`` is the first size a pair belongs to; size s is the union of the steps up to s.
    Pair numbers depend on ``stride``, not on the sizes asked for.
    """
    top = sizes[-1]
    k = F.expr(f"id % {top}")
    step = sum(((k >= F.lit(s)).cast("int") for s in sizes[:-1]), F.lit(0))
    trial = F.expr(f"id div {top}")
    ids = source.df.sparkSession.range(0, top * n_trials).select(
        (trial * F.lit(stride) + k).alias("pair_id"), trial.alias("trial"), step.alias("step")
    )
    return source.draw(ids, stream, top * n_trials)


def meeting_mode(spark: SparkSession, n_rows: int, n_pairs: int, key_bytes: int = 0) -> str:
    """How pairs meet a table that is too large to broadcast, by their sizes.

    ``ends``: all pair ends fit a broadcast. ``semi``: only their keys fit, and cut the table
    down before a shuffle join. ``shuffle``: neither fits, or the table has no more rows than
    there are pair ends, so that shuffling it costs no more than bringing the ends together.
    """
    if n_rows <= 2 * n_pairs:
        return "shuffle"
    return next((m for m in ("ends", "semi") if fits_ends(spark, n_pairs, m, key_bytes)), "shuffle")


def fits_ends(spark: SparkSession, n_pairs: int, mode: str, key_bytes: int = 0) -> bool:
    """Whether what ``ends`` or ``semi`` broadcasts of so many pairs fits."""
    each = _END_BYTES if mode == "ends" else _POSITION_BYTES
    return 2 * n_pairs * (each + key_bytes) <= broadcast_bytes(spark)


def meet(rows: DataFrame, ends: DataFrame, on: Sequence[str], mode: str) -> DataFrame:
    """Join the rows of a large table to the pair ends that ask for them."""
    if mode == "ends":
        return rows.join(F.broadcast(ends), list(on))
    if mode == "semi":
        wanted = ends.select(*on).distinct()
        return rows.join(F.broadcast(wanted), list(on), "left_semi").join(ends, list(on))
    return rows.join(ends, list(on))


def pair_ends(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: side 0 asks for stimulus i, side 1 for j."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("i").alias("sid")),
        F.struct(F.lit(1).alias("side"), F.col("j").alias("sid")),
    )
    keys = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.select(*keys, F.explode(sides).alias("_end")).select(*keys, "_end.side", "_end.sid")


def gather_by_lookup(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Both gathers against a broadcast table of (sid, payload), with no shuffle."""
    payload = [c for c in values.columns if c != "sid"]
    left = values.select(F.col("sid").alias("i"), *[F.col(c).alias(f"a_{c}") for c in payload])
    right = values.select(F.col("sid").alias("j"), *[F.col(c).alias(f"b_{c}") for c in payload])
    return pairs.join(F.broadcast(left), "i").join(F.broadcast(right), "j")


def wanted_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows, by their position ``sid``, that some pair asks for; one shuffle of the positions."""
    wanted = pairs.select(F.explode(F.array("i", "j")).alias("sid")).distinct()
    return rows.join(wanted, "sid", "left_semi")


def gather_by_shuffle(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Both gathers by shuffle joins to (sid, payload): first end, then second. A pair without its
    first row is lost; one without its second has no ``j``. The values were measured as too large
    for a broadcast, which Spark cannot tell from well compressed files."""
    payload = [c for c in values.columns if c != "sid"]
    left = values.select(F.col("sid").alias("i"), *[F.col(c).alias(f"a_{c}") for c in payload])
    right = values.select(F.col("sid").alias("_side"), *[F.col(c).alias(f"b_{c}") for c in payload])
    met = pairs.join(left.hint("merge"), "i").join(right.hint("merge"), F.col("j") == F.col("_side"), "left")
    keys = [c for c in pairs.columns if c not in ("i", "j")]
    return met.select(
        *keys, "i", F.col("_side").alias("j"), *[f"a_{c}" for c in payload], *[f"b_{c}" for c in payload]
    )


def assemble_ends(ends: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Put the two gathered rows of each pair side by side again; one shuffle on pair_id."""
    packed = ends.select(*keys, "side", F.struct("sid", *payload).alias("_a"))
    other = F.lead("_a").over(Window.partitionBy("pair_id").orderBy("side"))
    both = packed.withColumn("_b", other).filter(F.col("side") == 0)
    return both.select(
        *keys,
        F.col("_a.sid").alias("i"),
        F.col("_b.sid").alias("j"),
        *[F.col(f"_a.{c}").alias(f"a_{c}") for c in payload],
        *[F.col(f"_b.{c}").alias(f"b_{c}") for c in payload],
    )
