"""Leading eigenvalues of a symmetric matrix by spectrum slicing.

A factorization of the shifted matrix A - s I into L D Lᵀ has as many positive numbers in D as A has
eigenvalues above s. Such counts bisect to an interval that holds one eigenvalue alone, Rayleigh
quotient iteration finds it from within, and two more counts, close to both sides of what was
found, certify its number. Eigenvalues that lie too close for that are taken as one group, whose
vectors come from block inverse iteration and a projection onto its few dimensions.

These run on one small matrix, of as many rows as vectors have dimensions.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
# Fixed value: the pivot rule's bound on growth.
PIVOT = (1 + math.sqrt(17)) / 8
MOST_ROUNDS = 200
# Neighbours within this, of the largest eigenvalue's bound, join a group where one is needed.
GROUP_WIDTH = 1e-10


class Factor:
    """P A Pᵀ = L D Lᵀ, with pivots of one or two rows in D."""

    def __init__(self, a: np.ndarray):
        a, n = np.array(a, dtype=float), len(a)
        self.n, self.order, self.low = n, np.arange(n), np.eye(n)
        self.blocks: list[tuple[int, np.ndarray]] = []
        self.positive = 0
        k = 0
        while k < n:
            size, place = self._pivot(a, k)
            at = k + size - 1
            if place != at:
                a[[at, place]] = a[[place, at]]
                a[:, [at, place]] = a[:, [place, at]]
                self.order[[at, place]] = self.order[[place, at]]
                self.low[[at, place], :k] = self.low[[place, at], :k]
            d, c = a[k : k + size, k : k + size].copy(), a[k + size :, k : k + size].copy()
            self.blocks.append((k, d))
            # A pivot of two rows is only taken where its determinant is negative.
            self.positive += int(d[0, 0] > 0) if size == 1 else 1
            if c.any():
                part = c / d[0, 0] if size == 1 else np.linalg.solve(d, c.T).T
                self.low[k + size :, k : k + size] = part
                a[k + size :, k + size :] -= part @ c.T
            k += size

    @staticmethod
    def _pivot(a: np.ndarray, k: int) -> tuple[int, int]:
        """Rows of the next pivot, and the row that has to move to its end."""
        if k == len(a) - 1:
            return 1, k
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(np.argmax(column))
        most = column[r - k - 1]
        if abs(a[k, k]) >= PIVOT * most:
            return 1, k
        row = np.abs(a[k:, r])
        row[r - k] = 0
        beyond = row.max()
        if abs(a[k, k]) * beyond >= PIVOT * most * most:
            return 1, k
        if abs(a[r, r]) >= PIVOT * beyond:
            return 1, r
        return 2, r

    def solve(self, b: np.ndarray) -> np.ndarray:
        """x with A x = b; zero pivots count as tiny ones, as inverse iteration wants."""
        x = np.array(b, dtype=float)[self.order]
        for k in range(self.n):
            x[k + 1 :] -= np.multiply.outer(self.low[k + 1 :, k], x[k]).reshape(x[k + 1 :].shape)
        for k, d in self.blocks:
            if len(d) == 1:
                x[k] /= d[0, 0] if d[0, 0] else EPS * EPS
            else:
                x[k : k + 2] = np.linalg.solve(d, x[k : k + 2])
        for k in range(self.n - 1, -1, -1):
            x[k] -= np.tensordot(self.low[k + 1 :, k], x[k + 1 :], axes=1)
        out = np.empty_like(x)
        out[self.order] = x
        return out


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and unit eigenvectors as columns.

    Those not above rounding noise (n * eps of the largest) are left out, so fewer may come. The
    largest entry of every vector is positive.
    """
    a = np.asarray(matrix, dtype=float)
    n, scale = len(a), float(np.abs(a).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    slices = Slices(a / scale)
    values, vectors = [], []
    while len(values) < min(wanted, n):
        k = len(values) + 1
        found = slices.isolated(k)
        if found is None:
            break
        low, high, many = found
        alone = slices.within(low, high, k, vectors) if many == 1 else None
        if alone is not None:
            values.append(alone[0])
            vectors.append(alone[1])
        else:
            for value, vector in slices.group(low, high, k, vectors):
                values.append(value)
                vectors.append(vector)
    values, vectors = values[:wanted], vectors[:wanted]
    order = np.argsort(-np.array(values), kind="stable")
    basis = np.array(vectors).reshape(-1, n)[order].T
    turned = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return np.array(values)[order] * scale, basis * turned


class Slices:
    """A matrix with the counts of eigenvalues above the shifts that were tried."""

    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a)
        # No eigenvalue lies beyond a row's centre and radius.
        top = float(np.abs(a).sum(axis=1).max()) * (1 + 4 * EPS)
        self.floor = self.n * EPS * top
        self.finest = 8 * self.n * EPS * top
        self.counts = {self.floor: self.above(self.floor), top: 0}

    def above(self, shift: float) -> int:
        return Factor(self.a - shift * np.eye(self.n)).positive

    def count(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.above(shift)
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float] | None:
        """The closest shifts tried with at least ``k`` eigenvalues above, and with fewer."""
        low = max((s for s, c in self.counts.items() if c >= k), default=None)
        if low is None:
            return None
        return low, min(s for s, c in self.counts.items() if c < k and s > low)

    def isolated(self, k: int, finest: float | None = None) -> tuple[float, float, int] | None:
        """An interval with eigenvalue ``k`` and none larger, and how many it holds: one, or as
        many as cannot be told apart. None where eigenvalue ``k`` is not above the floor."""
        while (ends := self.bracket(k)) is not None:
            low, high = ends
            many = self.counts[low] - self.counts[high]
            middle = (low + high) / 2
            if many == 1 or high - low <= self.finest or not low < middle < high:
                return low, high, many
            self.count(middle)
        return None

    def within(self, low: float, high: float, k: int, before: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
        """The only eigenvalue of an interval, number ``k``, and its vector; None where its
        neighbours are too close for the counts to certify it."""
        vector = np.cos(np.arange(self.n) + 1.0)
        shift, best = (low + high) / 2, math.inf
        for _ in range(MOST_ROUNDS):
            vector = self._apart(Factor(self.a - shift * np.eye(self.n)).solve(vector), before)
            value = float(vector @ self.a @ vector)
            error = float(np.linalg.norm(self.a @ vector - value * vector))
            if not low <= value <= high or error > (high - low) / 2:
                # The quotient is led by other eigenvalues still: a count halves the interval first.
                if high - low > self.finest:
                    middle = (low + high) / 2
                    low, high = (middle, high) if self.count(middle) >= k else (low, middle)
                shift = (low + high) / 2
                continue
            if error <= 4 * EPS or error >= best / 2 and best <= self.finest:
                near = max(error, self.finest)
                if self.count(value - near) >= k and self.count(value + near) < k:
                    return value, vector
                return None
            shift, best = value, min(best, error)
        return None

    def group(self, low: float, high: float, k: int, before: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Eigenvalues too close to tell apart, the first of them number ``k``, and their vectors."""
        middle = (low + high) / 2
        many = max(self.count(low), self.count(max(self.floor, middle - GROUP_WIDTH))) - k + 1
        factor = Factor(self.a - middle * np.eye(self.n))
        basis = np.cos(np.multiply.outer(np.arange(self.n) + 1.0, np.arange(many) + 1.0))
        for _ in range(8):
            basis = factor.solve(basis)
            basis /= np.abs(basis).max(axis=0)
            for v in before:
                basis -= np.multiply.outer(v, v @ basis)
            basis = np.linalg.qr(basis)[0]
        values, turn = np.linalg.eigh(basis.T @ self.a @ basis)
        return list(zip(values[::-1].tolist(), (basis @ turn).T[::-1]))

    def _apart(self, vector: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """The vector at unit length, less its parts along those already found."""
        vector = vector / np.abs(vector).max()
        for v in before:
            vector = vector - (v @ vector) * v
        return vector / np.linalg.norm(vector)
