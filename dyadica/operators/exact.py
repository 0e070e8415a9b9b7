"""Moments of the feature distances over all n * n pairs, without making a pair.

A squared gap is a polynomial of its two ends, and a mismatch is 1 less a sum over the categories of
the ends' indicators. So sums over all ordered pairs, self-pairs included, part into products of sums
over the rows: power sums of the numbers, the same sums by category, and counts by two categories.
One grouping-sets aggregate over the rows gives them all, and a second one adds up its squares.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dyadica.functions.distances import NUMERIC
from dyadica.operators.encode import pair_values, scaling_bounds

# (p, q) of the terms a_i^p a_j^q of a squared gap, with their factors.
GAP = (((2, 0), 1.0), ((1, 1), -2.0), ((0, 2), 1.0))
POWERS = range(3)


@dataclass
class ExactMoments:
    """Means and covariances of the squared feature distances over all pairs."""

    names: list[str]
    pairs: int
    mean: np.ndarray
    cov: np.ndarray

    def correlation(self) -> np.ndarray:
        """Correlations; those of a feature without spread are 0."""
        spread = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        size = np.outer(spread, spread)
        return np.where(size > 0, self.cov / np.where(size > 0, size, 1.0), 0.0)


def exact_moments(source, nan_to_num: float = 0.0) -> ExactMoments:
    """Over all pairs of the rows of ``source``, whose numbers must be scaled: a gap of scaled
    numbers is at most 1, so nothing is clipped. A distance with a missing side is the fill."""
    if source.raw or not source.scale:
        raise ValueError("only scaled features have gaps of at most 1, which are not clipped")
    fill = min(abs(float(nan_to_num)), 1.0) ** 2
    kinds, df = source.kinds, source.df
    bounds = scaling_bounds(df, kinds, source.strict)
    numeric = [k for k, f in enumerate(kinds) if f.kind == NUMERIC]
    others = [k for k, f in enumerate(kinds) if f.kind != NUMERIC]
    rows = df.select(*[v.alias(f"v{k}") for k, v in enumerate(pair_values(df, kinds, bounds))])
    # Gaps do not change with the origin; at the means, sums lose the fewest digits.
    means = rows.agg(F.count(F.lit(1)), *[F.avg(f"v{k}") for k in numeric]).first()
    n, centre = means[0], dict(zip(numeric, means[1:]))
    rows = rows.select(*[
        (F.col(f"v{k}") - F.lit(float(centre[k] or 0.0)) if k in centre else F.col(f"v{k}")).alias(f"v{k}")
        for k in range(len(kinds))
    ])
    if not n:
        return ExactMoments(list(source.feature_names), 0, np.zeros(len(kinds)), np.zeros((len(kinds),) * 2))
    sums = _Sums(rows, numeric, others, n)
    mean = np.array([sums.mean(k, fill) for k in range(len(kinds))])
    cov = np.empty((len(kinds), len(kinds)))
    for a in range(len(kinds)):
        for b in range(a + 1):
            # fill + K has the covariance of K.
            cov[a, b] = cov[b, a] = sums.product(a, b, fill) / n**2 - (mean[a] - fill) * (mean[b] - fill)
    return ExactMoments(list(source.feature_names), n * n, mean, cov)


def _power(k: int, p: int) -> Column:
    """v^p where there is a value, else 0."""
    v = F.col(f"v{k}")
    known = F.lit(1.0) if p == 0 else v if p == 1 else v * v
    return F.when(v.isNotNull(), known).otherwise(F.lit(0.0))


class _Sums:
    """All sums that the moments need, from one aggregate by grouping sets.

    Written K(i, j), a feature's squared distance less its fill, where both ends have a value:
    sums over pairs of K of one feature and of products of two.
    """

    def __init__(self, rows: DataFrame, numeric: list[int], others: list[int], n: int):
        self.numeric, self.n = numeric, n
        plain = {f"p{a}_{p}": F.sum(_power(a, p)) for a in numeric for p in POWERS}
        plain |= {f"m{c}": F.sum(F.col(f"v{c}").isNotNull().cast("double")) for c in others}
        pairs = {
            f"p{a}_{p}_{b}_{q}": F.sum(_power(a, p) * _power(b, q))
            for a in numeric for b in numeric if b <= a for p in POWERS for q in POWERS
        }
        pairs |= {
            f"q{a}_{p}_{c}": F.sum(_power(a, p) * F.col(f"v{c}").isNotNull().cast("double"))
            for a in numeric for c in others for p in POWERS
        }
        pairs |= {
            f"m{c}_{e}": F.sum((F.col(f"v{c}").isNotNull() & F.col(f"v{e}").isNotNull()).cast("double"))
            for c, e in combinations(others, 2)
        }
        columns = [F.col(f"v{c}") for c in others]
        sets = [[], *[[c] for c in columns], *[list(two) for two in combinations(columns, 2)]]
        aggregates = [v.alias(name) for name, v in (plain | pairs).items()]
        aggregates += [F.count(F.lit(1)).cast("double").alias("rows_")]
        if others:
            grouped = rows.groupingSets(sets, *columns).agg(F.grouping_id().alias("set_"), *aggregates)
            # Categories that are missing match none: their groups count nothing.
            known = {
                self._set(others, two): [F.col(f"v{c}").isNotNull() for c in two]
                for two in [(c,) for c in others] + list(combinations(others, 2))
            }
            matched = F.lit(True)
            for number, present in known.items():
                for is_known in present:
                    matched = matched & ((F.col("set_") != number) | is_known)
            grouped = grouped.filter(matched)
        else:
            grouped = rows.agg(F.lit(0).alias("set_"), *aggregates)
        products = [F.sum(F.col(x) * F.col(y)).alias(f"{x}*{y}") for x, y in self._squares(numeric, others)]
        firsts = [F.max(name).alias(name) for name in plain | pairs]
        self.rows = {r["set_"]: r.asDict() for r in grouped.groupBy("set_").agg(*products, *firsts).collect()}
        self.whole = self.rows[(1 << len(others)) - 1 if others else 0]
        self.others = others

    @staticmethod
    def _set(others: list[int], two: tuple[int, ...]) -> int:
        """The grouping id: a bit for each column that is not grouped by, the first highest."""
        return sum(1 << (len(others) - 1 - k) for k, c in enumerate(others) if c not in two)

    @staticmethod
    def _squares(numeric: list[int], others: list[int]):
        """Pairs of sums whose products over the groups are wanted."""
        for a in numeric:
            for p in POWERS:
                for q in POWERS:
                    yield f"p{a}_{p}", f"p{a}_{q}"
        for c in others:
            yield f"m{c}", f"m{c}"
        yield "rows_", "rows_"

    def _matches(self, two: tuple[int, ...], x: str, y: str) -> float:
        """The sum over the groups by one or two categories of the product of two sums."""
        row = self.rows.get(self._set(self.others, two))
        value = None if row is None else row[f"{x}*{y}"]
        return value or 0.0

    def mean(self, k: int, fill: float) -> float:
        if k in self.numeric:
            power = [self.whole[f"p{k}_{p}"] for p in POWERS]
            total = sum(w * power[p] * power[q] for (p, q), w in GAP) - fill * power[0] ** 2
        else:
            total = (1 - fill) * self.whole[f"m{k}"] ** 2 - self._matches((k,), "rows_", "rows_")
        return fill + total / self.n**2

    def product(self, a: int, b: int, fill: float) -> float:
        """The sum over all pairs of K_a K_b, for b up to a."""
        gap = [*GAP, ((0, 0), -fill)]
        if a in self.numeric and b in self.numeric:
            at = lambda p, q: self.whole[f"p{a}_{p}_{b}_{q}"]
            return sum(u * w * at(p, r) * at(q, s) for (p, q), u in gap for (r, s), w in gap)
        if a in self.numeric or b in self.numeric:
            a, c = (a, b) if a in self.numeric else (b, a)
            both = [self.whole[f"q{a}_{p}_{c}"] for p in POWERS]
            out = 0.0
            for (p, q), u in gap:
                out += u * ((1 - fill) * both[p] * both[q] - self._matches((c,), f"p{a}_{p}", f"p{a}_{q}"))
            return out
        if a == b:
            return (1 - fill) ** 2 * self.whole[f"m{a}"] ** 2 + (
                1 - 2 * (1 - fill)
            ) * self._matches((a,), "rows_", "rows_")
        both = self.whole[f"m{b}_{a}"]
        matched = self._matches((a,), f"m{b}", f"m{b}") + self._matches((b,), f"m{a}", f"m{a}")
        return (1 - fill) ** 2 * both**2 - (1 - fill) * matched + self._matches((b, a), "rows_", "rows_")
