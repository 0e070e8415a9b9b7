"""Distances between the two sides of a pair, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

NUMERIC = "numeric"
CATEGORICAL = "categorical"

# Guards of the divisions, and the largest single-precision number, which
# stands in for an infinite distance.
COSINE_EPS = 1e-8
SCALE_EPS = 1e-8
LARGEST_SINGLE = 3.4028234663852886e38


def _missing() -> Column:
    return F.lit(None).cast("double")


def nan_as_null(col: Column) -> Column:
    return F.nanvl(col.cast("double"), _missing())


# ---------------------------------------------------------------- features


def feature_distance(kind: str, a: Column, b: Column, fill: float = 0.0) -> Column:
    """Gap clipped to [0, 1] for numbers, 0/1 mismatch for categories.

    ``fill`` is the distance when either side is missing.
    """
    if kind == NUMERIC:
        gap = F.nanvl(F.abs(a - b), _missing())
        known = F.least(F.lit(1.0), gap)
        known = F.when(gap.isNotNull(), known)
    else:
        known = (a != b).cast("double")
    return F.coalesce(known, F.lit(min(abs(float(fill)), 1.0)))


def lower_triangle(p: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(p) for c in range(r + 1)]


def term_names(names: Sequence[str], interactions: bool) -> list[str]:
    if not interactions:
        return list(names)
    return [
        names[r] if r == c else f"{names[r]} x {names[c]}" for r, c in lower_triangle(len(names))
    ]


def distance_terms(dist: Sequence[Column], interactions: bool) -> list[Column]:
    """Squares of the feature distances, or all lower-triangle products of them."""
    if interactions:
        return [dist[r] * dist[c] for r, c in lower_triangle(len(dist))]
    return [d * d for d in dist]


# More terms than this are computed by array functions instead of one expression each.
WIDE_TERMS = 64


def terms_array(dist: Sequence[Column], interactions: bool) -> Column:
    """The distance terms as one array column."""
    if not interactions or len(dist) * (len(dist) + 1) // 2 <= WIDE_TERMS:
        return F.array(*distance_terms(dist, interactions))
    d = F.array(*dist)
    rows = F.transform(d, lambda v, r: F.transform(F.slice(d, F.lit(1), r + 1), lambda u: v * u))
    return F.flatten(rows)


# ----------------------------------------------------------- representations


@dataclass(frozen=True)
class Side:
    """What a representation distance may read of one stimulus."""

    vector: Column | None
    norm: Column | None


@dataclass(frozen=True)
class Metric:
    name: str
    between: Callable[[Side, Side], Column]
    vector: bool = True
    norm: bool = False


def _sum_over(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, t: acc + t)
    bad = F.raise_error(F.lit("representations differ in length")).cast("double")
    # Added in front, so that it is checked first and the sum itself stays unconditional.
    return F.when(F.size(a) != F.size(b), bad).otherwise(F.lit(0.0)) + total


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, t: acc + t * t))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum_over(a, b, lambda u, v: (u - v) * (u - v)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum_over(a, b, lambda u, v: F.abs(u - v))


def cosine(a: Side, b: Side) -> Column:
    eps = F.lit(COSINE_EPS)
    dot = _sum_over(a.vector, b.vector, lambda u, v: u * v)
    return F.lit(1.0) - dot / (F.greatest(a.norm, eps) * F.greatest(b.norm, eps))


METRICS = {
    "euclidean": Metric("euclidean", lambda a, b: euclidean(a.vector, b.vector)),
    "manhattan": Metric("manhattan", lambda a, b: manhattan(a.vector, b.vector)),
    "cosine": Metric("cosine", cosine, norm=True),
    "norm_diff": Metric(
        "norm_diff", lambda a, b: F.abs(a.norm - b.norm), vector=False, norm=True
    ),
}
PRECOMPUTED = "precomputed"


def resolve_metric(distance: str | Callable[[Column, Column], Column]) -> Metric:
    """A named metric, or a callable of two vector columns (a pandas UDF is one too)."""
    if callable(distance):
        return Metric("custom", lambda a, b: distance(a.vector, b.vector))
    if distance in METRICS:
        return METRICS[distance]
    raise ValueError(f"no metric is called {distance!r}")


def clean_distance(d: Column, fill: float = 0.0) -> Column:
    """NaN and NULL become ``fill``; infinity becomes the largest single-precision number."""
    known = F.nanvl(d, _missing())
    top = F.lit(LARGEST_SINGLE)
    bounded = F.when(known > top, top).when(known < -top, -top).otherwise(known)
    return F.coalesce(bounded, F.lit(float(fill)))


def minmax_square(d: Column, low: Column, high: Column) -> Column:
    """Min-max scale a distance, then square it."""
    s = (d - low) / (high - low + F.lit(SCALE_EPS))
    return s * s
