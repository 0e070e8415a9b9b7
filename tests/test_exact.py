import numpy as np
import pytest

from dyadica import PrecomputedPairs, Stimuli
from dyadica.operators.exact import exact_moments


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b = rng.normal() * 1e-3 + 1e6, rng.uniform()
        c, e = str(rng.integers(0, 4)), int(rng.integers(0, 3))
        hide = rng.uniform(size=4) < 0.2
        rows.append((k, None if hide[0] else a, float("nan") if hide[1] else b, None if hide[2] else c, None if hide[3] else e))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c string, e int")


def brute(rows, names, categorical, fill):
    at = {"a": 1, "b": 2, "c": 3, "e": 4}
    x = []
    for name in names:
        v = [r[at[name]] for r in rows]
        v = [None if u is None or u != u else u for u in v]
        known = [u for u in v if u is not None]
        if name not in categorical:
            low, high = min(known), max(known)
            v = [None if u is None else (u - low) / (high - low) for u in v]
            gap = lambda s, t: abs(s - t)
        else:
            gap = lambda s, t: float(s != t)
        x.append([(fill if s is None or t is None else gap(s, t)) ** 2 for s in v for t in v])
    x = np.array(x)
    return x.mean(axis=1), np.cov(x, bias=True).reshape(len(names), len(names))


@pytest.mark.parametrize("fill", [0.0, 0.7, 1.0, -3.0])
@pytest.mark.parametrize("names, categorical", [
    (["a", "b", "c", "e"], ["c", "e"]), (["a", "b"], []), (["c", "e"], ["c", "e"]), (["e", "a"], ["e"]), (["c"], ["c"]), (["b"], []),
])
def test_exact_moments_by_brute_force(spark, fill, names, categorical):
    rows, df = table(spark, 40, len(names))
    got = exact_moments(Stimuli(df, names, None, "id", categorical=categorical, dense=True), fill)
    mean, cov = brute(rows, names, categorical, min(abs(fill), 1.0))
    assert got.pairs == 1600 and got.names == names
    assert got.mean == pytest.approx(mean, abs=1e-12) and got.cov == pytest.approx(cov, abs=1e-12)


def test_exact_moments_of_empty_and_single_tables(spark):
    _, df = table(spark, 30, 1)
    empty = exact_moments(Stimuli(df.limit(0), ["a", "c"], None, "id", dense=True))
    assert empty.pairs == 0 and not empty.cov.any()
    one = exact_moments(Stimuli(df.limit(1), ["a", "c"], None, "id"))
    assert one.pairs == 1 and not one.cov.any() and not one.correlation().any()
    with pytest.raises(ValueError, match="scaled"):
        exact_moments(Stimuli(df, ["a"], None, "id", scale=False))


def test_a_pair_that_stands_in_for_another_is_found(spark):
    n = 12
    rows = [(i, j, 0.1 * (i != j), 0.2 * (i != j)) for i in range(n) for j in range(n)]
    frame = lambda r: spark.createDataFrame(r, "i long, j long, a double, y double")
    assert PrecomputedPairs(frame(rows), ["a"], "y").size() == n
    rng = np.random.default_rng(1)
    for _ in range(5):
        k, m = rng.choice(n * n, size=2, replace=False)
        wrong = list(rows)
        wrong[k] = rows[m]
        with pytest.raises(ValueError, match="repeat"):
            PrecomputedPairs(frame(wrong), ["a"], "y").size()
    # Ends exchanged: (0, 1) twice for (1, 0), and (2, 3) for (3, 2).
    turned = [(min(i, j), max(i, j), a, y) if {i, j} == {0, 1} else (i, j, a, y) for i, j, a, y in rows]
    with pytest.raises(ValueError, match="repeat"):
        PrecomputedPairs(frame(turned), ["a"], "y").size()
    with pytest.raises(ValueError, match="expected"):
        PrecomputedPairs(frame(rows[:-1]), ["a"], "y").size()
