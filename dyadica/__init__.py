"""Pairwise metric encoding on Spark."""

from dyadica.plans.encoder import MetricEncoder
from dyadica.plans.recipes import cross_validate, fit_many, holdout
from dyadica.sources.precomputed import PrecomputedPairs
from dyadica.sources.stimuli import Stimuli, align

__all__ = ["MetricEncoder", "PrecomputedPairs", "Stimuli", "align", "cross_validate", "fit_many", "holdout"]
