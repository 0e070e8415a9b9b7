"""Weights from moments: a few numbers per feature, solved on the driver."""

from __future__ import annotations

import warnings

import numpy as np

# The usual Adam decay rates and divisor guard.
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8


def softplus(t: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, t)


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * t))


def inverse_softplus(v: np.ndarray) -> np.ndarray:
    v = np.maximum(v, 1e-12)
    return v + np.log(-np.expm1(-v))


class PositiveWeights:
    """Non-negative weights of unit length: softplus, then normalised."""

    def __init__(self, p: int) -> None:
        self.size = p

    def start(self, rng: np.random.Generator) -> np.ndarray:
        return rng.uniform(0.0, 1.0, self.size)

    def weights(self, theta: np.ndarray) -> np.ndarray:
        v = softplus(theta)
        return v / np.linalg.norm(v)

    def pull_back(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Gradient by theta of a scale-free function whose gradient by weights is ``grad``."""
        return grad * sigmoid(theta) / np.linalg.norm(softplus(theta))


class SpdWeights:
    """Lower triangle of a positive definite matrix with unit Frobenius norm, through its
    Cholesky factor with a softplus diagonal."""

    def __init__(self, p: int) -> None:
        self.p = p
        self.size = p * (p + 1) // 2
        self.tril = np.tril_indices(p)
        self.on_diag = self.tril[0] == self.tril[1]

    def start(self, rng: np.random.Generator) -> np.ndarray:
        return rng.uniform(-1.0, 1.0, self.size)

    def identity(self) -> np.ndarray:
        return np.where(self.on_diag, inverse_softplus(np.ones(self.size)), 0.0)

    def factor(self, theta: np.ndarray) -> np.ndarray:
        low = np.zeros((self.p, self.p))
        low[self.tril] = np.where(self.on_diag, softplus(theta), theta)
        return low

    def weights(self, theta: np.ndarray) -> np.ndarray:
        low = self.factor(theta)
        w = low @ low.T
        return (w / np.linalg.norm(w))[self.tril]

    def pull_back(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        low = self.factor(theta)
        g = np.zeros((self.p, self.p))
        g[self.tril] = grad
        by_factor = ((g + g.T) @ low) / np.linalg.norm(low @ low.T)
        out = by_factor[self.tril]
        return np.where(self.on_diag, out * sigmoid(theta), out)


def correlation(w: np.ndarray, sigma: np.ndarray, c: np.ndarray, var: float) -> float:
    spread = float(w @ sigma @ w) * var
    return float(w @ c) / np.sqrt(spread) if spread > 0 else 0.0


def correlation_gradient(w: np.ndarray, sigma: np.ndarray, c: np.ndarray, var: float) -> np.ndarray:
    sw = sigma @ w
    spread = float(w @ sw)
    if spread <= 0 or var <= 0:
        return np.zeros_like(w)
    return (c - sw * (float(w @ c) / spread)) / np.sqrt(spread * var)


class Adam:
    """Gradient ascent with decoupled weight decay."""

    def __init__(self, size: int, lr: float, weight_decay: float) -> None:
        self.lr, self.decay = lr, weight_decay
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * grad
        self.v = BETA2 * self.v + (1 - BETA2) * grad * grad
        m = self.m / (1 - BETA1**self.t)
        v = self.v / (1 - BETA2**self.t)
        return theta * (1 - self.lr * self.decay) + self.lr * m / (np.sqrt(v) + ADAM_EPS)


def ascend(
    shape, theta: np.ndarray, sigma: np.ndarray, c: np.ndarray, var: float,
    lr: float = 0.1, weight_decay: float = 0.0, max_iter: int = 5000, tol: float = 1e-7,
    patience: int = 200,
) -> np.ndarray:
    """Weights at the best point of an ascent on fixed moments, with a falling step size. It ends
    where ``patience`` steps have gained no more than ``tol``, as towards a bound they do at last."""
    opt = Adam(shape.size, lr, weight_decay)
    best, best_w, mark, waited = -np.inf, shape.weights(theta), -np.inf, 0
    for k in range(max_iter):
        w = shape.weights(theta)
        r = correlation(w, sigma, c, var)
        if r > best:
            best, best_w = r, w.copy()
        mark, waited = (r, 0) if r > mark + tol else (mark, waited + 1)
        if waited >= patience:
            break
        opt.lr = lr / (1 + 0.01 * k)
        theta = opt.step(theta, shape.pull_back(theta, correlation_gradient(w, sigma, c, var)))
    return best_w


def unit_diagonal(sigma: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same problem in features of unit spread, and the factors back; a feature without
    spread has factor 0."""
    diag = np.diag(sigma)
    factor = np.where(diag > 0, 1.0 / np.sqrt(np.where(diag > 0, diag, 1.0)), 0.0)
    return sigma * np.outer(factor, factor), c * factor, factor


def nnls_direction(sigma: np.ndarray, c: np.ndarray, sweeps: int = 20000, tol: float = 1e-15) -> np.ndarray:
    """Coordinate descent on w' sigma w / 2 - c' w over w >= 0."""
    sigma, residual, factor = unit_diagonal(sigma, c)
    w = np.zeros_like(residual)
    for _ in range(sweeps):
        moved = 0.0
        for k in np.flatnonzero(factor):
            new = max(0.0, w[k] + residual[k])
            step = new - w[k]
            if step:
                residual -= sigma[:, k] * step
                w[k] = new
                moved = max(moved, abs(step))
        if moved <= tol * np.abs(w).max():
            break
    else:
        warnings.warn(f"weights still moved after {sweeps} sweeps", UserWarning, stacklevel=2)
    return w * factor


def solve_positive(sigma: np.ndarray, c: np.ndarray, var: float) -> np.ndarray:
    """Best non-negative weights. When no feature has a positive covariance, every mixture
    correlates less than its best single feature, which is the answer then."""
    w = nnls_direction(sigma, c)
    norm = np.linalg.norm(w)
    if norm > 0:
        return w / norm
    spread = np.sqrt(np.maximum(np.diag(sigma), 0.0))
    alone = np.where(spread > 0, c / np.where(spread > 0, spread, 1.0), 0.0)
    if not alone.any():
        return np.full(len(c), 1.0 / np.sqrt(len(c)))
    return np.eye(len(c))[int(np.argmax(np.where(spread > 0, alone, -np.inf)))]


class Cone:
    """Least squares over positive semidefinite matrices, by Newton steps on a log barrier.

    The matrix is its lower triangle ``z``, each entry in units of ``factor``. With
    ``f(z) = z' sigma z / 2 - c' z``, each step minimises the second-order model of
    ``f - mu log det`` and ``mu`` falls by tenths. At the end ``f`` exceeds its least value by no
    more than p mu.
    """

    # Barrier weights, and a small pull to 0 along directions that change no prediction.
    FIRST_MU, LAST_MU, RIDGE = 1.0, 1e-15, 1e-11
    STEPS = 60

    def __init__(self, sigma: np.ndarray, c: np.ndarray, factor: np.ndarray, p: int):
        self.p, self.factor = p, factor
        self.sigma = sigma + self.RIDGE * np.eye(len(c))
        self.c = c
        self.rows, self.cols = np.tril_indices(p)
        self.twice = np.where(self.rows == self.cols, 1.0, 2.0)

    def matrix(self, z: np.ndarray) -> np.ndarray:
        full = np.zeros((self.p, self.p))
        full[self.rows, self.cols] = full[self.cols, self.rows] = z * self.factor
        return full

    def value(self, z: np.ndarray, mu: float) -> float:
        try:
            low = np.linalg.cholesky(self.matrix(z))
        except np.linalg.LinAlgError:
            return np.inf
        return 0.5 * z @ self.sigma @ z - self.c @ z - 2 * mu * np.log(np.diag(low)).sum()

    def gradient(self, z: np.ndarray) -> np.ndarray:
        return self.sigma @ z - self.c

    def newton(self, z: np.ndarray, mu: float) -> tuple[np.ndarray, float]:
        """The Newton step of ``f - mu log det``, and its decrement."""
        inverse = np.linalg.inv(self.matrix(z))
        r, c = self.rows, self.cols
        scale = self.factor * self.twice
        gradient = self.gradient(z) - mu * scale * inverse[r, c]
        curved = inverse[np.ix_(r, r)] * inverse[np.ix_(c, c)] + inverse[np.ix_(r, c)] * inverse[np.ix_(c, r)]
        step = -np.linalg.solve(self.sigma + mu * curved * np.outer(scale, scale) / 2, gradient)
        return step, float(-gradient @ step)

    def solve(self) -> np.ndarray:
        z = np.where(self.rows == self.cols, 1.0 / self.factor, 0.0)
        z = z / max(1.0, np.abs(z).max())
        mu = self.FIRST_MU
        while mu >= self.LAST_MU:
            for _ in range(self.STEPS):
                try:
                    step, drop = self.newton(z, mu)
                except np.linalg.LinAlgError:
                    return z
                if not np.isfinite(drop) or drop <= 1e-3 * mu:
                    break
                size, now = 1.0, self.value(z, mu)
                while size > 1e-12 and not self.value(z + size * step, mu) <= now - 1e-4 * size * drop:
                    size /= 2
                if size <= 1e-12:
                    break
                z = z + size * step
            mu /= 10
        return z


def spd_conditions(w: np.ndarray, sigma: np.ndarray, c: np.ndarray, p: int) -> tuple[float, float, float]:
    """How far weights are from the best semidefinite ones: the least eigenvalue of their matrix,
    that of the gradient's at the best length, and the product of both matrices, each in units
    of its own size. All are 0 or more but for rounding, and the last is 0, at the optimum."""
    rows, cols = np.tril_indices(p)
    length = (w @ c) / (w @ sigma @ w)
    found, slope = np.zeros((p, p)), np.zeros((p, p))
    found[rows, cols] = found[cols, rows] = w
    g = sigma @ (w * length) - c
    slope[rows, cols] = slope[cols, rows] = np.where(rows == cols, g, g / 2)
    size = max(np.abs(c).max(), 1e-300)
    return (
        float(np.linalg.eigvalsh(found)[0] / np.linalg.norm(found)),
        float(np.linalg.eigvalsh(slope)[0] / size),
        float((found * slope).sum() / (np.linalg.norm(found) * size)),
    )


def solve_spd(sigma: np.ndarray, c: np.ndarray, var: float, p: int) -> np.ndarray:
    """Best positive definite weights.

    The least squares direction is the best of all; when it is positive definite it is the
    answer. Otherwise the least squares over the cone is, since its direction correlates best of
    all in the cone. Features whose terms are all without spread get weight 0. Only where no matrix
    of the cone correlates positively an ascent looks for the least bad one.
    """
    shape = SpdWeights(p)
    unit, unit_c, factor = unit_diagonal(sigma, c)
    free = np.linalg.lstsq(unit, unit_c, rcond=1e-12)[0] * factor
    full = np.zeros((p, p))
    full[shape.tril] = free
    full = full + np.tril(full, -1).T
    values, vectors = np.linalg.eigh(full)
    if values[0] > 1e-9 * max(values[-1], 0.0) and values[-1] > 0:
        return free / np.linalg.norm(full)
    rows, cols = shape.tril
    spread = np.flatnonzero(np.bincount(np.concatenate([rows, cols]), np.concatenate([factor, factor]), minlength=p))
    kept = np.isin(rows, spread) & np.isin(cols, spread)
    if len(spread):
        # An entry without spread of its own has unit factor: nothing but the cone bounds it.
        part = np.where(factor[kept] > 0, factor[kept], 1.0)
        cone = Cone(unit[np.ix_(kept, kept)], unit_c[kept], part, len(spread))
        w = np.zeros(len(c))
        w[kept] = cone.solve() * part
        whole = np.zeros((p, p))
        whole[shape.tril] = w
        length = np.linalg.norm(whole + np.tril(whole, -1).T)
        if length > 0 and correlation(w, sigma, c, var) > 1e-9:
            return w / length
    starts = [shape.identity()]
    if values[-1] > 0:
        lifted = vectors @ np.diag(np.maximum(values, 1e-3 * values[-1])) @ vectors.T
        low = np.linalg.cholesky(lifted / np.linalg.norm(lifted))
        starts.append(np.where(shape.on_diag, inverse_softplus(low[shape.tril]), low[shape.tril]))
    ends = [ascend(shape, t, sigma, c, var) for t in starts]
    return max(ends, key=lambda w: correlation(w, sigma, c, var))
