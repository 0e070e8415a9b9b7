"""Pearson and Spearman correlation as Spark aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dyadica.operators.ranks import ORDINAL, rank_by, rank_value

# Fixed value: guard of both standard deviations.
CORR_EPS = 1e-8
# A spread below this share of the sum of squares is rounding noise of a constant column.
CONSTANT_SHARE = 1e-12


def corr_from_sums(sxy: Column, sxx: Column, syy: Column) -> Column:
    """Correlation from centred sums; a constant input gives 0."""
    eps = F.lit(CORR_EPS)
    return sxy / ((F.sqrt(F.greatest(sxx, F.lit(0.0))) + eps) * (F.sqrt(F.greatest(syy, F.lit(0.0))) + eps))


def pearson_eps(x: Column, y: Column) -> Column:
    """Aggregate expression: Pearson correlation with guarded divisors."""
    n = F.count(F.lit(1))
    return corr_from_sums(F.covar_pop(x, y) * n, F.var_pop(x) * n, F.var_pop(y) * n)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate expression: plain Pearson correlation; NULL or NaN on constant input."""
    return F.corr(x, y)


def spearman(
    df: DataFrame,
    group: str,
    x: str,
    y: str,
    tie: str,
    rows_per_group: int,
    ties: str = ORDINAL,
    digits: int | None = None,
    name: str = "spearman",
) -> DataFrame:
    """Spearman correlation of ``x`` and ``y`` per batch: (group, name)."""
    vals = df.select(
        group, tie, rank_value(F.col(x), digits).alias("_x"), rank_value(F.col(y), digits).alias("_y")
    )
    ranked = rank_by(vals, group, "_x", tie, "_rx", rows_per_group, ties)
    ranked = rank_by(ranked, group, "_y", tie, "_ry", rows_per_group, ties)
    rx, ry = F.col("_rx").cast("double"), F.col("_ry").cast("double")
    return ranked.groupBy(group).agg(pearson_eps(rx, ry).alias(name))


# ------------------------------------------------ feature correlations by batch size


def prefix_correlations(moments: DataFrame, p: int) -> DataFrame:
    """Correlation of every feature pair for every (trial, size).

    ``moments`` has (trial, step, pos, value) with the moments of the pairs that enter at
    each step; running sums over the steps give the moments of every prefix. The number of
    rows depends on trials, sizes and features only.
    """
    from dyadica.operators.moments import COUNT, SUMS

    w = Window.partitionBy("trial", "pos").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = (
        moments.filter(F.col("pos") >= COUNT)
        .withColumn("value", F.sum("value").over(w))
        .groupBy("trial", "step")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("m"))
        .withColumn("m", F.col("m.value"))
    )

    def at(pos: Column) -> Column:
        return F.get(F.col("m"), (pos - F.lit(COUNT)).cast("int"))

    a, b = F.col("a"), F.col("b")

    def gram(r: Column, c: Column) -> Column:
        return at(F.lit(SUMS + p) + (r * (r + 1) / 2).cast("int") + c)

    n = at(F.lit(COUNT))
    sa, sb = at(F.lit(SUMS) + a), at(F.lit(SUMS) + b)
    pairs = running.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(p - 1)))).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.col("a") - 1))
    )
    sab = gram(a, b) - sa * sb / n
    saa, sbb = gram(a, a) - sa * sa / n, gram(b, b) - sb * sb / n
    constant = (saa <= gram(a, a) * CONSTANT_SHARE) | (sbb <= gram(b, b) * CONSTANT_SHARE)
    corr = F.when(constant, F.lit(0.0)).otherwise(corr_from_sums(sab, saa, sbb))
    return pairs.select("trial", "step", "a", "b", corr.alias("corr"))


def stability(correlations: DataFrame) -> DataFrame:
    """Per size: the largest spread over trials and the largest mean correlation."""
    per_pair = correlations.groupBy("step", "a", "b").agg(
        F.stddev_samp("corr").alias("sd"), F.avg("corr").alias("mean")
    )
    return per_pair.groupBy("step").agg(
        F.max("sd").alias("max_std"), F.max(F.abs("mean")).alias("max_corr")
    )
