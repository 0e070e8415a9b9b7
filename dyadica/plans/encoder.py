"""The estimator: configuration, fit, score, weights."""

from __future__ import annotations

import logging
import secrets
import warnings
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dyadica.functions.distances import PRECOMPUTED, lower_triangle, resolve_metric, term_names
from dyadica.operators.ranks import ORDINAL
from dyadica.plans.batch_size import estimate_batch_size
from dyadica.plans.fit import FitResult, fit_pooled, fit_steps
from dyadica.plans.importance import importance_table, predict, scores_table, wide_importances
from dyadica.session import materialize
from dyadica.sources.precomputed import PrecomputedPairs
from dyadica.sources.stimuli import Stimuli

log = logging.getLogger(__name__)

POOLED = "pooled"
STEPS = "steps"


class MetricEncoder:
    """Learns a metric over features that follows the distances of a representation.

    ``solver='pooled'`` solves on the moments of all ``batch_size * max_steps`` pairs (a
    number for ``max_fit_pairs`` ends it there). A positive ``tolerance`` is a cut by choice: pairs
    are read in growing blocks, and those after a block that moves no weight by more are not read;
    ``solver='steps'`` runs Adam over a fresh batch per step with early stopping, and alone
    uses ``lr``, ``weight_decay`` and ``patience``.
    ``ties`` is the rank rule of the scores: ``ordinal`` or ``average``.
    A seed makes every call repeatable, whatever the partitioning.
    """

    def __init__(
        self,
        interactions: bool = False,
        n_permutations: int = 5,
        distance: str | Callable[[Column, Column], Column] = "euclidean",
        nan_to_num: float = 0.0,
        batch_size: int | None = None,
        n_trials: int = 16,
        threshold: float = 0.01,
        factor: float = 1.2,
        batch_size_min: int = 256,
        batch_size_max: int = 2**20,
        max_steps: int = 1000,
        lr: float = 0.1,
        weight_decay: float = 0.0,
        patience: int = 50,
        random_seed: int | None = None,
        corr_warning_threshold: float = 0.5,
        solver: str = POOLED,
        max_fit_pairs: int | None = None,
        tolerance: float = 0.0,
        ties: str = ORDINAL,
    ) -> None:
        if distance != PRECOMPUTED:
            resolve_metric(distance)
        if solver not in (POOLED, STEPS):
            raise ValueError(f"unknown solver: {solver}")
        if not factor > 1:
            raise ValueError(f"factor must exceed 1, got {factor}")
        _check_size(batch_size)
        if solver == POOLED and (lr, weight_decay, patience) != (0.1, 0.0, 50):
            warnings.warn(
                "lr, weight_decay and patience act with solver='steps' only", UserWarning, stacklevel=2
            )
        self.interactions = interactions
        self.n_permutations = n_permutations
        self.distance = distance
        self.nan_to_num = nan_to_num
        self.batch_size = batch_size
        self.n_trials = n_trials
        self.threshold = threshold
        self.factor = factor
        self.batch_size_min = batch_size_min
        self.batch_size_max = batch_size_max
        self.max_steps = max_steps
        self.lr = lr
        self.weight_decay = weight_decay
        self.patience = patience
        self.random_seed = random_seed
        self.corr_warning_threshold = corr_warning_threshold
        self.solver = solver
        self.max_fit_pairs = max_fit_pairs
        self.tolerance = tolerance
        self.ties = ties

        self.fit_: FitResult | None = None
        self.source_: Stimuli | PrecomputedPairs | None = None
        self.feature_names: list[str] | None = None
        self.batch_size_fit_: int | None = None

    # ---------------------------------------------------------------- helpers

    def _seed(self) -> int:
        return secrets.randbits(31) if self.random_seed is None else self.random_seed

    def _check_source(self, source) -> None:
        if isinstance(source, PrecomputedPairs) != (self.distance == PRECOMPUTED):
            raise ValueError(
                "distance='precomputed' goes with PrecomputedPairs, other distances with Stimuli"
            )

    def _fitted(self) -> FitResult:
        if self.fit_ is None:
            raise RuntimeError("call fit first")
        return self.fit_

    # --------------------------------------------------------------- estimate

    def estimate_batch_size(self, source: Stimuli | PrecomputedPairs) -> int:
        """A batch size that suffices for these features; it does not read representations."""
        self._check_source(source)
        return estimate_batch_size(
            source, self.batch_size_min, self.n_trials, self.threshold,
            self.factor, self.batch_size_max, self.corr_warning_threshold,
            f"{self._seed()}:size", self.nan_to_num,
        )

    # -------------------------------------------------------------------- fit

    def fit(self, source: Stimuli | PrecomputedPairs) -> "MetricEncoder":
        self._check_source(source)
        seed = self._seed()
        size = self.batch_size
        if size is None:
            size = self.estimate_batch_size(source)
        stream = f"{seed}:fit"
        if self.solver == POOLED:
            result = fit_pooled(
                source, self.distance, self.interactions, self.nan_to_num,
                self.pairs_to_fit(size), size, stream, self.tolerance,
            )
        else:
            result = fit_steps(
                source, self.distance, self.interactions, self.nan_to_num, size,
                self.max_steps, self.lr, self.weight_decay, self.patience, stream, seed,
            )
        return self.take(result, source, size)

    def pairs_to_fit(self, size: int) -> int:
        """How many pairs the pooled solver reads."""
        n_pairs = size * self.max_steps
        return n_pairs if self.max_fit_pairs is None else max(size, min(n_pairs, self.max_fit_pairs))

    def take(self, result: FitResult, source, size: int) -> "MetricEncoder":
        """Hold a fit of this source."""
        self.fit_, self.source_, self.batch_size_fit_ = result, source, size
        self.feature_names = list(source.feature_names)
        log.info("fitted on %d pairs, correlation %.4f", result.n_pairs, result.correlation)
        return self

    # ------------------------------------------------------------------ score

    def score(
        self,
        source: Stimuli | PrecomputedPairs | None = None,
        warning_threshold: float = 0.05,
        batch_size: int | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """Importances and baseline scores, on the training data or on other data.

        Other data are scaled on their own bounds. The result, one row per feature and
        permutation, is written once so that reading it does not score again.
        """
        fit = self._fitted()
        source = self.source_ if source is None else source
        self._check_source(source)
        missing = [f for f in self.feature_names if f not in source.feature_names]
        if missing or len(source.feature_names) != len(self.feature_names):
            raise ValueError(f"features differ from the fitted ones: {self.feature_names}")
        _check_size(batch_size)
        size = batch_size
        if size is None:
            size = self.batch_size_fit_ if self.batch_size is None else self.batch_size
        weights = self._weights_for(source)
        table = materialize(
            importance_table(
                source, weights, size, self.n_permutations,
                self.distance, self.interactions, self.nan_to_num, f"{self._seed()}", self.ties,
            )
        )
        stats = table.agg(
            F.stddev_samp("baseline").alias("sd"), F.min("n").alias("lo"), F.max("n").alias("hi")
        ).first()
        if stats["lo"] != size or stats["hi"] != size:
            raise ValueError("not all sampled pairs were found; ids must be unique and complete")
        if stats["sd"] is not None and stats["sd"] > warning_threshold:
            warnings.warn(
                f"Scores vary between batches (std {stats['sd']:.3f} > {warning_threshold:.3f}). "
                "Lower `threshold`, raise `batch_size_min`, or set a larger `batch_size`.",
                UserWarning,
                stacklevel=2,
            )
        return table, scores_table(table)

    def _weights_for(self, source) -> np.ndarray:
        """Fitted weights in the feature order of ``source``."""
        order = [self.feature_names.index(f) for f in source.feature_names]
        w = self._fitted().weights
        if not self.interactions:
            return w[order]
        spot = {rc: k for k, rc in enumerate(lower_triangle(len(order)))}
        return np.array(
            [
                w[spot[max(order[r], order[c]), min(order[r], order[c])]]
                for r, c in lower_triangle(len(order))
            ]
        )

    def wide(self, importances: DataFrame) -> DataFrame:
        return wide_importances(importances, self.term_names)

    @property
    def term_names(self) -> list[str]:
        self._fitted()
        return term_names(self.feature_names, self.interactions)

    # ---------------------------------------------------------------- weights

    def predict(self, pairs: DataFrame, name: str = "prediction") -> DataFrame:
        """Predicted squared distance of pairs that carry the distance terms ``x``."""
        return pairs.withColumn(name, predict(self._fitted().weights))

    def get_weights(self) -> DataFrame:
        """(feature, weight), or (row_feature, col_feature, weight) with interactions."""
        weights = self._fitted().weights
        spark = self.source_.df.sparkSession
        return weights_table(spark, weights, self.feature_names, self.interactions)


def _check_size(size: int | None) -> None:
    if size is not None and size < 1:
        raise ValueError(f"a batch needs at least one pair, got {size}")


def weights_table(spark, weights: Sequence[float], names: Sequence[str], interactions: bool) -> DataFrame:
    if interactions:
        rows = [
            (names[r], names[c], float(w)) for (r, c), w in zip(lower_triangle(len(names)), weights)
        ]
        return spark.createDataFrame(rows, "row_feature string, col_feature string, weight double")
    rows = [(f, float(w)) for f, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, weight double")


def square_weights(weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """The lower-triangular matrix form; entries above the diagonal are NULL."""
    return weights.groupBy("row_feature").pivot("col_feature", list(names)).agg(F.first("weight"))
