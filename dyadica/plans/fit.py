"""Fitting the weights: one distributed pass for the moments, a small solve on the driver."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dyadica.functions.distances import PRECOMPUTED, SCALE_EPS, resolve_metric
from dyadica.operators.moments import (
    Moments, collect_moments, many_moments, moment_vectors, provisional_centre, scaled_square_moments,
    use_expressions, vector_length,
)
from dyadica.operators.pairs import counted_pairs, sample_pair_range
from dyadica.plans import solver as S

STEPS_PER_JOB = 100
# The provisional centre comes from so many pairs; it decides digits, not results.
CENTRE_PAIRS = 4096
# The pooled solver's first block of pairs; each further one doubles what has been read.
FIRST_BLOCK_PAIRS = 1 << 20
# A spread below this share of a feature's mean square is rounding noise of a constant one.
CONSTANT_SHARE = 1e-24
# Bound on the moments one job of the stepwise solver brings to the driver.
MOMENT_BYTES_PER_JOB = 256 * 1024 * 1024


@dataclass
class FitResult:
    weights: np.ndarray
    correlation: float
    n_pairs: int
    steps: int


def n_terms(p: int, interactions: bool) -> int:
    return p * (p + 1) // 2 if interactions else p


EXTRAS = ("d", "d2")


def _late(q: int, interactions: bool) -> bool:
    """Whether interaction products are formed where they are summed."""
    return interactions and not use_expressions(q, EXTRAS)


def pair_centre(source, batch_size: int, distance, interactions: bool, nan_to_num: float, stream: str) -> np.ndarray:
    """A provisional centre of the terms, d and d*d, from the first pairs of the stream."""
    p = source.n_features
    q = n_terms(p, interactions)
    late = _late(q, interactions)
    n = min(CENTRE_PAIRS, batch_size)
    pairs = sample_pair_range(source, 0, n, batch_size, stream)
    dist = source.distances(pairs, n, distance, interactions, nan_to_num, expand=not late)
    found = provisional_centre(dist, p if late else q, True)
    x, d = found[:-1], found[-1]
    if late:
        left, right = np.tril_indices(p)
        x = x[left] * x[right]
    return np.concatenate([x, [d, 0.0]])


def fit_moments(
    source, pairs: DataFrame, n_pairs: int, distance, interactions: bool, nan_to_num: float,
    centre: np.ndarray, by: str | None = None, weight: str | None = None,
) -> dict[int, Moments]:
    """Moments of the terms, d and d*d over the pairs, less their centre, pooled or per batch;
    ``weight`` names a column of how often each pair counts."""
    p = source.n_features
    q = n_terms(p, interactions)
    late = _late(q, interactions)
    dist = source.distances(pairs, n_pairs, distance, interactions, nan_to_num, expand=not late)
    e = F.col("d") - F.lit(float(centre[q]))
    wide = dist.withColumn("d2", e * e)
    vectors = moment_vectors(wide, q, EXTRAS, (by,) if by else (), p if late else None, centre, weight)
    return collect_moments(vectors, q + 2, by)


def objective(mom: Moments, q: int, low: float, high: float, centre: np.ndarray):
    """Covariances of the terms among each other and with the scaled squared distance. A term
    that is constant but for rounding gets exact zeros."""
    sigma, c, var = scaled_square_moments(mom, q, low - centre[q], high - centre[q], SCALE_EPS)
    spread = np.diag(sigma)
    constant = spread <= CONSTANT_SHARE * ((mom.mean + centre)[:q] ** 2 + spread)
    sigma, c = sigma.copy(), np.where(constant, 0.0, c)
    sigma[constant, :] = sigma[:, constant] = 0.0
    return sigma, c, var


def steps_per_job(source, distance, q: int, max_steps: int) -> int:
    """Small stimuli: blocks, so that stopping early saves work. Large ones: as few scans as
    the size of the collected moments allows."""
    small = source.is_small(None if distance == PRECOMPUTED else resolve_metric(distance))
    wanted = STEPS_PER_JOB if small else max_steps
    return max(1, min(wanted, MOMENT_BYTES_PER_JOB // (24 * vector_length(q + 2))))


def _expect(n: float, wanted: int) -> None:
    if int(n) != wanted:
        raise ValueError(
            f"{int(n)} of {wanted} sampled pairs were found; ids must be unique and complete"
        )


def _check_span(mom: Moments, w: np.ndarray, n: int) -> None:
    if float(np.sum(np.abs(w))) * max(mom.top, 0.0) > n / 2:
        warnings.warn(
            "Predicted distances may span more than half the batch size; the Pearson "
            "objective then differs from the soft-rank one.",
            UserWarning,
            stacklevel=3,
        )


def fit_pooled(
    source, distance, interactions: bool, nan_to_num: float,
    n_pairs: int, batch_size: int, stream: str, tolerance: float = 0.0,
) -> FitResult:
    """Best weights on the moments of the sampled pairs.

    Where far more pairs are drawn than there are, each is measured once and weighed by how often
    it was drawn. Pairs are read in blocks, each as large as all before it, and the moments are merged. It
    ends when all pairs are read, or when a block has moved no weight by more than
    ``tolerance``; 0 reads all pairs.
    """
    p = source.n_features
    q = n_terms(p, interactions)
    centre = pair_centre(source, batch_size, distance, interactions, nan_to_num, stream)
    mom, w, done, blocks = None, None, 0, 0
    while done < n_pairs:
        size = n_pairs if tolerance <= 0 else max(FIRST_BLOCK_PAIRS, done)
        last = min(n_pairs, done + size)
        counted = counted_pairs(source, n_pairs, batch_size, stream) if last - done == n_pairs else None
        pairs = sample_pair_range(source, done, last, batch_size, stream) if counted is None else counted
        weight = None if counted is None else "times"
        block = fit_moments(
            source, pairs, last - done, distance, interactions, nan_to_num, centre, weight=weight
        )[0]
        _expect(block.n, last - done)
        mom = block if mom is None else mom.merged(block)
        done, blocks = last, blocks + 1
        sigma, c, var = objective(mom, q, mom.low, mom.high, centre)
        old, w = w, S.solve_spd(sigma, c, var, p) if interactions else S.solve_positive(sigma, c, var)
        if old is not None and np.max(np.abs(w - old)) <= tolerance:
            break
    _check_span(mom, w, batch_size)
    return FitResult(w, S.correlation(w, sigma, c, var), done, blocks)


def fit_many(
    source, targets, distance, interactions: bool, nan_to_num: float,
    n_pairs: int, batch_size: int, stream: str,
) -> list[FitResult]:
    """Best weights for each of several representations of the same stimuli, from one reading of
    the same pairs: the sums of the feature terms are shared. As ``fit_pooled`` on each."""
    p = source.n_features
    q = n_terms(p, interactions)
    late = _late(q, interactions)
    if not targets:
        return []
    centres = _centres(source, targets, batch_size, distance, interactions, nan_to_num, stream)
    counted = counted_pairs(source, n_pairs, batch_size, stream)
    pairs = sample_pair_range(source, 0, n_pairs, batch_size, stream) if counted is None else counted
    dist = source.distances(
        pairs, n_pairs, distance, interactions, nan_to_num, expand=not late, targets=targets
    )
    weight = None if counted is None else "times"
    out = []
    for mom, centre in zip(many_moments(dist, q, len(targets), p if late else None, centres, weight), centres):
        _expect(mom.n, n_pairs)
        out.append(_best(mom, centre, q, p, interactions, n_pairs, batch_size))
    return out


def _centres(source, targets, batch_size, distance, interactions, nan_to_num, stream) -> np.ndarray:
    """A row of provisional centres a target, each as ``pair_centre`` gives it."""
    p = source.n_features
    q = n_terms(p, interactions)
    late = _late(q, interactions)
    n = min(CENTRE_PAIRS, batch_size)
    pairs = sample_pair_range(source, 0, n, batch_size, stream)
    dist = source.distances(pairs, n, distance, interactions, nan_to_num, expand=not late, targets=targets)
    width = p if late else q
    wide = dist.select("x", *[F.get("d", F.lit(k)).alias(f"_t{k}") for k in range(len(targets))])
    means = [F.avg(F.get("x", F.lit(k))).alias(f"_c{k}") for k in range(width)]
    row = wide.agg(*means, *[F.avg(f"_t{k}").alias(f"_m{k}") for k in range(len(targets))]).first()
    found = np.array([0.0 if v is None else float(v) for v in row])
    x = found[:width]
    if late:
        left, right = np.tril_indices(p)
        x = x[left] * x[right]
    return np.array([[*x, d, 0.0] for d in found[width:]])


def _best(mom: Moments, centre, q, p, interactions, n_pairs, batch_size) -> FitResult:
    sigma, c, var = objective(mom, q, mom.low, mom.high, centre)
    w = S.solve_spd(sigma, c, var, p) if interactions else S.solve_positive(sigma, c, var)
    _check_span(mom, w, batch_size)
    return FitResult(w, S.correlation(w, sigma, c, var), n_pairs, 1)


def fit_folds(
    source, fold: str, factors: list[np.ndarray], distance, interactions: bool, nan_to_num: float,
    n_pairs: int, batch_size: int, stream: str,
) -> list[FitResult]:
    """Best weights for the rows outside each fold, from one reading of the same pairs.

    Moments are taken by the folds of both ends of a pair; those of the pairs without an end in a
    fold are the sum of the others' cells. ``factors`` brings each fold's feature distances from
    the scale of all rows to that of its training rows.
    """
    p, k = source.n_features, len(factors)
    q = n_terms(p, interactions)
    centre = pair_centre(source, batch_size, distance, interactions, nan_to_num, stream)
    counted = counted_pairs(source, n_pairs, batch_size, stream)
    pairs = sample_pair_range(source, 0, n_pairs, batch_size, stream) if counted is None else counted
    cells = _cell_moments(
        source, pairs, n_pairs, distance, interactions, nan_to_num, centre, fold, k,
        None if counted is None else "times",
    )
    _expect(sum(m.n for m in cells.values()), n_pairs)
    out = []
    for f in range(k):
        mine = [m for cell, m in cells.items() if f not in divmod(cell, k)]
        if not mine:
            raise ValueError(f"no pair was drawn outside fold {f}")
        mom = reduce(Moments.merged, mine)
        by_term = _term_factors(factors[f], interactions)
        scaled = mom.rescaled(np.concatenate([by_term, [1.0, 1.0]]))
        here = np.concatenate([centre[:q] * by_term, centre[q:]])
        out.append(_best(scaled, here, q, p, interactions, int(mom.n), batch_size))
    return out


def _term_factors(factor: np.ndarray, interactions: bool) -> np.ndarray:
    if not interactions:
        return factor * factor
    rows, cols = np.tril_indices(len(factor))
    return factor[rows] * factor[cols]


def _cell_moments(
    source, pairs, n_pairs, distance, interactions, nan_to_num, centre, fold, k, weight
) -> dict[int, Moments]:
    p = source.n_features
    q = n_terms(p, interactions)
    late = _late(q, interactions)
    dist = source.distances(
        pairs, n_pairs, distance, interactions, nan_to_num, expand=not late, carry=[fold]
    )
    e = F.col("d") - F.lit(float(centre[q]))
    cell = F.col(f"a_c_{fold}") * F.lit(k) + F.col(f"b_c_{fold}")
    wide = dist.withColumn("d2", e * e).withColumn("_cell", cell)
    vectors = moment_vectors(wide, q, EXTRAS, ("_cell",), p if late else None, centre, weight)
    return collect_moments(vectors, q + 2, "_cell")


def fit_steps(
    source, distance, interactions: bool, nan_to_num: float,
    batch_size: int, max_steps: int, lr: float, weight_decay: float, patience: int,
    stream: str, seed: int,
) -> FitResult:
    """Adam over a fresh batch per step, from per-step moments.

    Distances are scaled by the bounds seen so far. Steps are computed in blocks, so stopping
    early saves the later blocks. The weights kept are those that scored best.
    """
    p = source.n_features
    q = n_terms(p, interactions)
    shape = S.SpdWeights(p) if interactions else S.PositiveWeights(p)
    theta = shape.start(np.random.default_rng(seed))
    opt = S.Adam(shape.size, lr, weight_decay)
    best, best_w, waited, taken = -np.inf, shape.weights(theta), 0, 0
    low, high = np.inf, -np.inf
    centre = pair_centre(source, batch_size, distance, interactions, nan_to_num, stream)
    per_job = steps_per_job(source, distance, q, max_steps)
    for first in range(0, max_steps, per_job):
        last = min(first + per_job, max_steps)
        n_pairs = (last - first) * batch_size
        pairs = sample_pair_range(
            source, first * batch_size, last * batch_size, batch_size, stream
        )
        moments = fit_moments(
            source, pairs, n_pairs, distance, interactions, nan_to_num, centre, "trial"
        )
        for step in range(first, last):
            mom = moments[step]
            _expect(mom.n, batch_size)
            low, high = min(low, mom.low), max(high, mom.high)
            sigma, c, var = objective(mom, q, low, high, centre)
            w = shape.weights(theta)
            r = S.correlation(w, sigma, c, var)
            grad = shape.pull_back(theta, S.correlation_gradient(w, sigma, c, var))
            theta = opt.step(theta, grad)
            taken += 1
            if r > best:
                best, best_w, waited = r, w.copy(), 0
            else:
                waited += 1
            if waited >= patience:
                break
        if waited >= patience:
            break
    _check_span(mom, best_w, batch_size)
    return FitResult(best_w, best, taken * batch_size, taken)
