import warnings

import numpy as np
import pytest

from dyadica.plans import solver as S


def problem(q, seed=0, weights=None, noise=0.05):
    rng = np.random.default_rng(seed)
    x = rng.uniform(size=(4000, q))
    w = rng.uniform(size=q) if weights is None else np.asarray(weights, float)
    s = x @ w + noise * rng.normal(size=4000)
    full = np.cov(np.column_stack([x, s]).T, bias=True)
    return full[:q, :q], full[:q, q], full[q, q], w / np.linalg.norm(w)


@pytest.mark.parametrize("shape", [S.PositiveWeights(4), S.SpdWeights(3)])
def test_gradients(shape):
    sigma, c, var, _ = problem(len(shape.weights(np.zeros(shape.size))), 3)
    theta = shape.start(np.random.default_rng(5))

    def value(t):
        return S.correlation(shape.weights(t), sigma, c, var)

    grad = shape.pull_back(theta, S.correlation_gradient(shape.weights(theta), sigma, c, var))
    step = 1e-6
    for k in range(shape.size):
        e = np.eye(shape.size)[k] * step
        assert grad[k] == pytest.approx((value(theta + e) - value(theta - e)) / (2 * step), abs=1e-7)


def test_constraints():
    rng = np.random.default_rng(0)
    for _ in range(20):
        w = S.PositiveWeights(5).weights(rng.normal(size=5) * 3)
        assert (w >= 0).all() and np.linalg.norm(w) == pytest.approx(1)
        shape = S.SpdWeights(4)
        full = np.zeros((4, 4))
        full[shape.tril] = shape.weights(rng.normal(size=shape.size))
        full = full + np.tril(full, -1).T
        assert np.linalg.eigvalsh(full)[0] > 0 and np.linalg.norm(full) == pytest.approx(1)


def test_positive_recovers_planted_weights():
    sigma, c, var, w = problem(5, 1, [0.8, 0.0, 0.4, 0.1, 0.3], 0.01)
    got = S.solve_positive(sigma, c, var)
    assert got @ w > 0.9999 and got[1] < 0.01


def test_positive_is_no_worse_than_the_ascent():
    for seed in range(5):
        sigma, c, var, _ = problem(4, seed, np.random.default_rng(seed).normal(size=4))
        exact = S.correlation(S.solve_positive(sigma, c, var), sigma, c, var)
        shape = S.PositiveWeights(4)
        climbed = S.correlation(S.ascend(shape, np.zeros(4), sigma, c, var), sigma, c, var)
        assert exact >= climbed - 1e-9


def test_all_negative_covariances_fall_back():
    sigma, c, var, _ = problem(3, 0, [-1.0, -0.5, -0.2])
    w = S.solve_positive(sigma, c, var)
    assert (w >= 0).all() and np.linalg.norm(w) == pytest.approx(1)


def test_spd_inside_and_outside_the_cone():
    sigma, c, var, _ = problem(3, 0, [0.5, 0.3, 0.3], 0.0)
    got = S.solve_spd(sigma, c, var, 2)
    full = np.array([[0.5, 0.3], [0.3, 0.3]])
    np.testing.assert_allclose(got, np.array([0.5, 0.3, 0.3]) / np.linalg.norm(full), atol=1e-6)
    sigma, c, var, _ = problem(3, 0, [0.5, 0.6, 0.3], 0.0)
    got = S.solve_spd(sigma, c, var, 2)
    m = np.array([[got[0], got[1]], [got[1], got[2]]])
    assert np.linalg.eigvalsh(m)[0] > -1e-12 and np.linalg.norm(m) == pytest.approx(1)
    edge = max(
        S.correlation(np.array([1.0, t, t * t]), sigma, c, var) for t in np.linspace(0.01, 5, 5000)
    )
    assert S.correlation(got, sigma, c, var) == pytest.approx(edge, abs=2e-4)


def test_adam_matches_its_definition():
    opt = S.Adam(1, 0.1, 0.0)
    theta = opt.step(np.zeros(1), np.array([3.0]))
    assert theta[0] == pytest.approx(0.1, abs=1e-8)
    decayed = S.Adam(1, 0.1, 0.5).step(np.ones(1), np.zeros(1))
    assert decayed[0] == pytest.approx(0.95)


def drawn(p, kind, seed):
    """Moments of a quadratic form of random features that mostly is not semidefinite."""
    rng = np.random.default_rng(seed)
    d = rng.uniform(size=(2000, p)) if kind != "mismatch" else 1.0 * (rng.uniform(size=(2000, p)) < 0.5)
    if kind == "constant":
        d[:, 0] = 0
    r, c = np.tril_indices(p)
    x = d[:, r] * d[:, c]
    s = x @ (rng.normal(size=len(r)) + 1.0 * (r == c)) + 0.1 * rng.normal(size=2000)
    full = np.cov(np.column_stack([x, s]).T, bias=True)
    return full[: len(r), : len(r)], full[: len(r), len(r)], full[len(r), len(r)]


@pytest.mark.parametrize("kind", ["gap", "mismatch", "constant"])
@pytest.mark.parametrize("p", [2, 3, 6])
def test_spd_meets_the_conditions_of_the_optimum(p, kind):
    shape, on_edge = S.SpdWeights(p), 0
    for seed in range(6):
        sigma, c, var = drawn(p, kind, seed)
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            w = S.solve_spd(sigma, c, var, p)
        r = S.correlation(w, sigma, c, var)
        climbed = S.ascend(shape, shape.identity(), sigma, c, var)
        assert r >= S.correlation(climbed, sigma, c, var) - 1e-9
        if r > 1e-6:
            inside, slope, apart = S.spd_conditions(w, sigma, c, p)
            assert inside > -1e-9 and slope > -1e-6 and abs(apart) < 1e-9
            on_edge += inside < 1e-6
    assert on_edge or p == 2


def test_positive_without_positive_covariances_is_the_best_single_feature():
    for seed in range(5):
        sigma, c, var, _ = problem(3, seed, -np.random.default_rng(seed).uniform(0.1, 1, size=3))
        w = S.solve_positive(sigma, c, var)
        assert sorted(w) == [0, 0, 1]
        rng = np.random.default_rng(seed)
        others = [S.correlation(v, sigma, c, var) for v in rng.uniform(size=(500, 3))]
        assert S.correlation(w, sigma, c, var) >= max(others)
    assert S.solve_positive(np.zeros((2, 2)), np.zeros(2), 1.0) == pytest.approx([0.5**0.5] * 2)
