import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.queries import QUERIES
from dyadica import MetricEncoder, Stimuli, cross_validate, fit_many
from dyadica.functions.distances import SCALE_EPS
from dyadica.operators.pairs import sample_pair_range
from dyadica.operators.splits import train_test_split, with_fold
from dyadica.plans import fit as P, solver as S


def rows_of(n=60, seed=4, missing=False):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(size=n) * 10, rng.normal(size=n) ** 3
    c = rng.integers(0, 3, n)
    y = np.column_stack([0.3 * a, b, c, rng.normal(size=(n, 2))])
    z = np.column_stack([c, a * 0.1])
    rows = [(k, float(a[k]), float(b[k]), "xyz"[c[k]], y[k].tolist(), z[k].tolist()) for k in range(n)]
    if missing:
        rows[5] = (5, None, *rows[5][2:])
        rows[6] = (6, rows[6][1], float("nan"), *rows[6][3:])
        rows[7] = (*rows[7][:3], None, *rows[7][4:])
    return rows


def source_of(spark, rows=None):
    df = spark.createDataFrame(rows or rows_of(), "id long, a double, b double, c string, y array<double>, z array<double>")
    return Stimuli(df, ["a", "b", "c"], "y", "id", dense=True)


@pytest.mark.parametrize("interactions", [False, True])
@pytest.mark.parametrize("distance, size", [("euclidean", 3000), ("norm_diff", 30), ("cosine", 30)])
@pytest.mark.filterwarnings("ignore:Scores vary")
def test_many_targets_equal_single_fits(spark, interactions, distance, size):
    source = source_of(spark, rows_of(missing=True))
    encoder = MetricEncoder(batch_size=size, max_steps=4, random_seed=5, distance=distance, interactions=interactions)
    fitted = fit_many(encoder, source, {"one": "y", "two": "z", "both": ["y", "z"]})
    for name, target in (("two", "z"), ("both", ["y", "z"])):
        alone = MetricEncoder(batch_size=size, max_steps=4, random_seed=5, distance=distance, interactions=interactions)
        alone.fit(source.with_target(target))
        assert fitted[name].fit_.weights == pytest.approx(alone.fit_.weights, abs=1e-7 if interactions else 1e-9)
        assert fitted[name].fit_.n_pairs == alone.fit_.n_pairs == 4 * size
    if size == 30 and distance == "cosine" and not interactions:
        assert fitted["two"].score()[0].count() == len(fitted["two"].term_names) * 5


def test_many_targets_scan_the_pairs_once(spark, monkeypatch):
    source, made = source_of(spark), []
    plain = P.sample_pair_range
    monkeypatch.setattr(P, "sample_pair_range", lambda *a, **k: made.append(a[2]) or plain(*a, **k))
    fit_many(MetricEncoder(batch_size=50, max_steps=10, random_seed=5), source, {"one": "y", "two": "z"})
    assert made.count(500) == 1 and len(made) == 2  # the pairs, and the few of the centre
    pairs = plain(source, 0, 100, 50, "s")
    plan = source.distances(pairs, 100, "euclidean", targets=["y", "z"], mode="lookup")._jdf.queryExecution().toString()
    assert plan.split("== Optimized")[1].split("== Physical")[0].count("Range (0, 100") == 1
    assert fit_many(MetricEncoder(batch_size=50), source, {}) == {}


def test_many_targets_by_steps(spark):
    source = source_of(spark)
    encoder = MetricEncoder(batch_size=50, max_steps=5, random_seed=5, solver="steps")
    got = fit_many(encoder, source, {"one": "y", "two": "z"})
    alone = MetricEncoder(batch_size=50, max_steps=5, random_seed=5, solver="steps").fit(source.with_target("z"))
    assert got["two"].fit_.weights == pytest.approx(alone.fit_.weights)


def brute_fold(spark, source, folded, f, n_pairs, size, stream, interactions, fill=0.0):
    """A fit on the drawn pairs without an end in a fold, in numpy."""
    rows = {r["id"]: r for r in folded.collect()}
    train = [r for r in rows.values() if r["fold"] != f]
    ok = lambda v: v is not None and v == v
    span = {c: (min(r[c] for r in train if ok(r[c])), max(r[c] for r in train if ok(r[c]))) for c in "ab"}
    x, d = [], []
    for p in sample_pair_range(source, 0, n_pairs, size, stream).collect():
        s, t = rows[p["i"]], rows[p["j"]]
        if f in (s["fold"], t["fold"]):
            continue
        g = [abs(s[c] - t[c]) / (span[c][1] - span[c][0]) if ok(s[c]) and ok(t[c]) else fill for c in "ab"]
        g.append(float(s["c"] != t["c"]) if s["c"] and t["c"] else fill)
        g = np.array(g)
        x.append(np.outer(g, g)[np.tril_indices(3)] if interactions else g * g)
        d.append(np.linalg.norm(np.array(s["y"]) - np.array(t["y"])))
    x, d = np.array(x), np.array(d)
    s = ((d - d.min()) / (d.max() - d.min() + SCALE_EPS)) ** 2
    q = x.shape[1]
    full = np.cov(np.column_stack([x, s]).T, bias=True)
    solve = (lambda *a: S.solve_spd(*a, 3)) if interactions else S.solve_positive
    return solve(full[:q, :q], full[:q, q], full[q, q]), len(d)


@pytest.mark.parametrize("interactions", [False, True])
@pytest.mark.parametrize("size", [100, 1500])
def test_folds_equal_fits_on_the_same_pairs(spark, interactions, size):
    from dyadica.plans.recipes import _fit_folds, _fold_factors

    source, k = source_of(spark, rows_of(missing=True)), 3
    encoder = MetricEncoder(batch_size=size, max_steps=6, random_seed=5, interactions=interactions)
    folded = with_fold(source.df, k, source.keys, 1)
    fits, _ = _fit_folds(encoder, source, folded, _fold_factors(encoder, source, folded, k))
    n_pairs = int(np.ceil(size * 6 * 9 / 4))
    for f in range(k):
        want, n = brute_fold(spark, source, folded, f, n_pairs, size, "5:fit", interactions)
        assert fits[f].n_pairs == n and abs(n - size * 6) < 0.35 * size * 6
        assert fits[f].weights == pytest.approx(want, abs=1e-6)


@pytest.mark.filterwarnings("ignore:Scores vary")
def test_cross_validation_in_one_pass(spark, monkeypatch):
    source, made = source_of(spark), []
    plain = P.sample_pair_range
    monkeypatch.setattr(P, "sample_pair_range", lambda *a, **k: made.append(a[2]) or plain(*a, **k))
    encoder = MetricEncoder(batch_size=200, max_steps=5, random_seed=5, n_permutations=2)
    fi, scores = cross_validate(encoder, source, 3, 1)
    assert made.count(int(np.ceil(1000 * 9 / 4))) == 1 and len(made) == 2
    assert sorted({r["split"] for r in scores.collect()}) == [0, 1, 2] and fi.count() == 3 * 3 * 2


def test_one_pass_steps_back_where_scales_do_not_tell(spark):
    from dyadica.plans.recipes import _fold_factors

    source = source_of(spark, rows_of(missing=True))
    folded = with_fold(source.df, 3, source.keys, 1)
    assert _fold_factors(MetricEncoder(), source, folded, 3) is not None
    # A fill is not scaled with the numbers, so factors do not reach it.
    assert _fold_factors(MetricEncoder(nan_to_num=1.0), source, folded, 3) is None
    assert _fold_factors(MetricEncoder(solver="steps"), source, folded, 3) is None
    rows = rows_of()
    rows[0] = (0, float("inf"), *rows[0][1:2], *rows[0][3:])
    assert _fold_factors(MetricEncoder(), source_of(spark, rows), with_fold(source_of(spark, rows).df, 3, "id", 1), 3) is None
    constant = [(k, 1.0, 2.0 if k else 5.0, "x", [float(k)], [0.0]) for k in range(9)]
    source = source_of(spark, constant)
    folded = source.df.withColumn("fold", (F.col("id") % 3).cast("int"))
    factors = _fold_factors(MetricEncoder(), source, folded, 3)
    # Without row 0 the second feature is constant: its gaps are 0 at any scale.
    assert factors[1].tolist() == [1.0, 1.0, 1.0] and factors[0].tolist() == [1.0, 3.0, 1.0]


def test_null_ids_fall_somewhere(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "id long, v int")
    train, test = train_test_split(df, "id", 50, 1)
    assert train.count() + test.count() == 4
    assert with_fold(df, 3, "id", 1).filter("fold is null").count() == 0
    assert len({r["fold"] for r in with_fold(df, 3, "id", 1).filter("id is null").collect()}) == 1


def test_registered_bounds_are_active(spark, sf):
    zero = {r["feature"]: r["weight"] for r in QUERIES["fit_zero_weight"](spark, sf).collect()}
    assert zero["nation"] == 0 and zero["gap"] > 0.1 and zero["mismatch"] > 0.1
    w = {(r["row_feature"], r["col_feature"]): r["weight"] for r in QUERIES["fit_edge"](spark, sf).collect()}
    assert w["gap", "gap"] * w["mismatch", "mismatch"] == pytest.approx(w["mismatch", "gap"] ** 2, abs=1e-5)
    assert X.OUTSIDE[1] ** 2 > X.OUTSIDE[0] * X.OUTSIDE[2]
