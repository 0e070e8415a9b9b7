"""Recipes: held-out score, k-fold cross-validation, several representations at once."""

from __future__ import annotations

import copy
import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dyadica.functions.distances import NUMERIC
from dyadica.operators.encode import scaling_bounds
from dyadica.operators.splits import train_test_split, with_fold
from dyadica.plans import fit as P
from dyadica.plans.encoder import POOLED, MetricEncoder
from dyadica.sources.stimuli import Stimuli


def holdout(
    encoder: MetricEncoder, stimuli: Stimuli, train_percent: int = 75, seed: int = 0, **score
) -> tuple[DataFrame, DataFrame]:
    """Fit on the training rows and score on the others."""
    train, test = train_test_split(stimuli.df, stimuli.keys, train_percent, seed)
    return encoder.fit(stimuli.replace(train)).score(stimuli.replace(test), **score)


def fit_many(
    encoder: MetricEncoder, stimuli: Stimuli, targets: Mapping[str, str | Sequence[str]]
) -> dict[str, MetricEncoder]:
    """A fitted encoder for each named representation of the same stimuli.

    The batch size is estimated once, and the pooled solver reads the pairs once for all: as if
    every representation were fitted by itself with the same seed. The stepwise solver fits them
    one after the other.
    """
    encoder._check_source(stimuli)
    seed = encoder._seed()
    size = encoder.batch_size or encoder.estimate_batch_size(stimuli)
    views = {name: stimuli.with_target(target) for name, target in targets.items()}
    fitted = {name: _named(encoder, seed, size) for name in targets}
    if encoder.solver != POOLED or encoder.tolerance > 0:
        return {name: each.fit(views[name]) for name, each in fitted.items()}
    results = P.fit_many(
        stimuli, list(targets.values()), encoder.distance, encoder.interactions, encoder.nan_to_num,
        encoder.pairs_to_fit(size), size, f"{seed}:fit",
    )
    for (name, each), result in zip(fitted.items(), results):
        each.take(result, views[name], size)
    return fitted


def _named(encoder: MetricEncoder, seed: int, size: int) -> MetricEncoder:
    """The same settings with this seed and size."""
    other = copy.copy(encoder)
    other.random_seed, other.batch_size = seed, size
    return other


def cross_validate(
    encoder: MetricEncoder, stimuli: Stimuli, k: int = 5, seed: int = 0, one_pass: bool = True, **score
) -> tuple[DataFrame, DataFrame]:
    """Fit and score once per fold; results carry the fold as ``split``.

    In ``one_pass`` the pooled solver draws pairs over all rows, in such number that each fold's
    training rows hold as many as one fit reads, and reads them once for all folds. Else, and where
    a fill for missing numbers or an infinite number stands against it, pairs are drawn and read
    for each fold by itself.
    """
    folded = with_fold(stimuli.df, k, stimuli.keys, seed)
    factors = _fold_factors(encoder, stimuli, folded, k) if one_pass else None
    fits = None if factors is None else _fit_folds(encoder, stimuli, folded, factors)
    importances, scores = [], []
    for f in range(k):
        train = stimuli.replace(folded.filter(F.col("fold") != f).drop("fold"))
        if fits is None:
            encoder.fit(train)
        else:
            encoder.take(fits[0][f], train, fits[1])
        fi, s = encoder.score(stimuli.replace(folded.filter(F.col("fold") == f).drop("fold")), **score)
        importances.append(fi.withColumn("split", F.lit(f)))
        scores.append(s.withColumn("split", F.lit(f)))
    return reduce(DataFrame.unionByName, importances), reduce(DataFrame.unionByName, scores)


def _fold_factors(
    encoder: MetricEncoder, stimuli: Stimuli, folded: DataFrame, k: int
) -> list[np.ndarray] | None:
    """What brings each feature's distances from the scale of all rows to that of a fold's training
    rows; None where no factor does."""
    if encoder.solver != POOLED or encoder.tolerance > 0 or k < 2:
        return None
    ones = [np.ones(stimuli.n_features) for _ in range(k)]
    numeric = [f for f in stimuli.kinds if f.kind == NUMERIC]
    if stimuli.raw or not stimuli.scale or not numeric:
        return ones
    lows, highs = _fold_bounds(folded, [f.column for f in numeric], k)
    whole = scaling_bounds(stimuli.df, numeric, stimuli.strict)
    for f in range(k):
        others = [g for g in range(k) if g != f]
        low, high = lows[others].min(axis=0), highs[others].max(axis=0)
        spread = np.where(high > low, high - low, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = 1.0 / spread / np.array([whole[c.column].scale for c in numeric])
        of_feature = dict(zip([c.column for c in numeric], factor))
        ones[f] = np.array([of_feature[c.column] if c.kind == NUMERIC else 1.0 for c in stimuli.kinds])
    if not np.isfinite(ones).all() or encoder.nan_to_num and (np.array(ones) != 1.0).any():
        return None
    return ones


def _fold_bounds(folded: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of every column in every fold; infinite the other way round where
    it has none."""
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    rows = folded.groupBy("fold").agg(
        F.array(*[F.min(v) for v in values]).alias("lo"), F.array(*[F.max(v) for v in values]).alias("hi")
    ).collect()
    lows, highs = np.full((k, len(columns)), np.inf), np.full((k, len(columns)), -np.inf)
    for r in rows:
        lows[r["fold"]] = [np.inf if v is None else v for v in r["lo"]]
        highs[r["fold"]] = [-np.inf if v is None else v for v in r["hi"]]
    return lows, highs


def _fit_folds(encoder: MetricEncoder, stimuli: Stimuli, folded: DataFrame, factors: list[np.ndarray]):
    """(fits, batch size) for the training rows of all folds."""
    k, seed = len(factors), encoder._seed()
    size = encoder.batch_size or encoder.estimate_batch_size(stimuli)
    whole = stimuli.replace(folded)
    whole.dense = stimuli.dense
    n_pairs = math.ceil(encoder.pairs_to_fit(size) * k * k / (k - 1) ** 2)
    fits = P.fit_folds(
        whole, "fold", factors, encoder.distance, encoder.interactions, encoder.nan_to_num,
        n_pairs, size, f"{seed}:fit",
    )
    return fits, size
