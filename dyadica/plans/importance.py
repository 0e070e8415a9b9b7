"""Prediction and permutation feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dyadica.functions.distances import WIDE_TERMS, term_names
from dyadica.operators.correlation import pearson_eps
from dyadica.operators.pairs import sample_pair_range, sample_pairs
from dyadica.operators.ranks import (
    ORDINAL, rank_by, rank_correlations, rank_value, shuffle_within, shuffle_within_large,
)
from dyadica.session import group_rows, materialize, release, shuffle_partitions, written

# Large batches are permuted and ranked in rounds of so many pairs, or a batch where it has more: what
# a round writes is deleted before the next.
ROUND_PAIRS = 1 << 24


def predict(weights: Sequence[float], x: str = "x") -> Column:
    """Weighted sum of the distance terms."""
    values = [F.lit(float(w)) for w in weights]
    if len(values) > WIDE_TERMS:
        products = F.zip_with(F.col(x), F.array(*values), lambda v, w: v * w)
        return F.aggregate(products, F.lit(0.0), lambda acc, t: acc + t)
    return sum((w * F.get(F.col(x), F.lit(k)) for k, w in enumerate(values)), F.lit(0.0))


def without_term(weights: Sequence[float], term: Column, x: str = "x") -> Column:
    """The weighted sum of all terms but one."""
    values = [F.lit(float(w)) for w in weights]
    if len(values) > WIDE_TERMS:
        others = F.transform(
            F.zip_with(F.col(x), F.array(*values), lambda v, w: v * w),
            lambda t, k: F.when(k != term, t).otherwise(F.lit(0.0)),
        )
        return F.aggregate(others, F.lit(0.0), lambda acc, t: acc + t)
    return sum(
        (
            F.when(term != k, w * F.get(F.col(x), F.lit(k))).otherwise(F.lit(0.0))
            for k, w in enumerate(values)
        ),
        F.lit(0.0),
    )


def importance_table(
    source,
    weights: Sequence[float],
    batch_size: int,
    n_permutations: int = 5,
    distance="euclidean",
    interactions: bool = False,
    nan_to_num: float = 0.0,
    stream: str = "0",
    ties: str = ORDINAL,
    digits: int | None = None,
) -> DataFrame:
    """(feature, permutation, n, baseline, permuted, importance), from one plan.

    Every (feature, permutation) is a fresh batch. After the gather only the permuted term,
    the rest of the prediction and the distance travel, in one shuffle by batch. Batches beyond
    half the configured group size are permuted and ranked over all partitions, in rounds of whole
    batches, from tables that are written on the way and deleted again.
    """
    names = term_names(source.feature_names, interactions)
    n_batches = len(names) * n_permutations
    term = F.expr(f"cast(trial div {n_permutations} as int)")
    wanted = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k") + 1)

    def narrow_of(pairs: DataFrame, n_pairs: int, mode: str) -> DataFrame:
        dist = source.distances(pairs, n_pairs, distance, interactions, nan_to_num, mode)
        return dist.withColumn("_k", term).select(
            "trial",
            "pair_id",
            without_term(weights, F.col("_k")).alias("rest"),
            (wanted * F.get(F.col("x"), F.col("_k"))).alias("part"),
            rank_value(F.col("d"), digits).alias("y"),
        )

    def scored_of(mixed: DataFrame) -> DataFrame:
        return mixed.select(
            "trial",
            "pair_id",
            "y",
            rank_value(F.col("rest") + F.col("part"), digits).alias("base"),
            rank_value(F.col("rest") + F.col("moved"), digits).alias("perm"),
        )

    spark = source.df.sparkSession
    # The permutation makes two records of a row.
    if ties == ORDINAL and 2 * batch_size > group_rows(spark):
        result = None
        per_round = max(1, ROUND_PAIRS // batch_size)
        for first in range(0, n_batches, per_round):
            last = min(first + per_round, n_batches)
            n_pairs = batch_size * (last - first)
            pairs = sample_pair_range(source, first * batch_size, last * batch_size, batch_size, stream)
            mark = written(spark)
            narrow = materialize(narrow_of(pairs, n_pairs, "packed"), tidy=True)
            mixed = shuffle_within_large(narrow, "trial", "part", stream, "moved", batch_size)
            scored = materialize(scored_of(mixed), tidy=True)
            release(spark, mark, mark + 1)
            found = rank_correlations(scored, "trial", "y", ["base", "perm"], "pair_id", n_pairs)
            release(spark, mark, mark + 1)
            found = found.select("trial", "n", F.col("base").alias("baseline"), F.col("perm").alias("permuted"))
            result = found if result is None else result.unionByName(found)
    else:
        narrow = narrow_of(sample_pairs(source, batch_size, n_batches, stream), batch_size * n_batches, "auto")
        if n_batches > shuffle_partitions(spark):
            # More batches than partitions: one partition per batch spreads them evenly.
            narrow = narrow.repartitionById(n_batches, F.col("trial").cast("int"))
        scored = scored_of(shuffle_within(narrow, "trial", "part", stream, "moved", batch_size))
        for value in ("y", "base", "perm"):
            scored = rank_by(scored, "trial", value, "pair_id", f"r_{value}", batch_size, ties)
        ry, rb, rp = (F.col(f"r_{v}").cast("double") for v in ("y", "base", "perm"))
        result = scored.groupBy("trial").agg(
            F.count(F.lit(1)).alias("n"),
            pearson_eps(rb, ry).alias("baseline"),
            pearson_eps(rp, ry).alias("permuted"),
        )
    label = F.element_at(F.array(*[F.lit(s) for s in names]), term + 1)
    return result.select(
        label.alias("feature"),
        F.expr(f"cast(trial % {n_permutations} as int)").alias("permutation"),
        "n",
        "baseline",
        "permuted",
        (F.col("baseline") - F.col("permuted")).alias("importance"),
    )


def scores_table(importances: DataFrame) -> DataFrame:
    """Baseline scores: (feature, permutation, spearman)."""
    return importances.select("feature", "permutation", F.col("baseline").alias("spearman"))


def wide_importances(importances: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per permutation and one column per feature or interaction."""
    return (
        importances.groupBy("permutation")
        .pivot("feature", list(names))
        .agg(F.first("importance"))
    )
