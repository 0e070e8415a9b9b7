import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog import fixtures as X
from dyadica.functions.hashing import DRAWS_KEY, MD5
from dyadica import MetricEncoder, PrecomputedPairs, Stimuli, cross_validate, holdout
from dyadica.operators.pairs import sample_pairs
from dyadica.operators.splits import train_test_split, with_fold
from dyadica.plans.encoder import square_weights
from dyadica.plans.importance import importance_table
from dyadica.session import BROADCAST_BYTES_KEY, GROUP_ROWS_KEY

WANT = np.array([0.6, 0.3, 0.1, 0.0]) / np.linalg.norm([0.6, 0.3, 0.1])


def weights_of(encoder):
    got = {r["feature"]: r["weight"] for r in encoder.get_weights().collect()}
    return np.array([got[f] for f in encoder.feature_names])


def test_planted_weights_and_importances(spark, sf):
    source = X.planted(spark, sf)
    encoder = MetricEncoder(batch_size=1024, max_steps=20, random_seed=1).fit(source)
    np.testing.assert_allclose(weights_of(encoder), WANT, atol=1e-4)
    assert encoder.fit_.correlation == pytest.approx(1)
    importances, scores = encoder.score()
    pdf = importances.toPandas()
    assert len(pdf) == 20 and (pdf.baseline > 0.9999).all()
    mean = pdf.groupby("feature").importance.mean()
    assert mean.f1 > mean.f2 > mean.f3 > mean.f4
    assert (pdf[pdf.feature == "f4"].importance == 0).all()
    assert scores.columns == ["feature", "permutation", "spearman"] and scores.count() == 20
    wide = encoder.wide(importances)
    assert wide.columns == ["permutation", "f1", "f2", "f3", "f4"] and wide.count() == 5


def test_fixed_seed_ignores_partitioning_and_gather_path(spark, sf, conf):
    def run():
        e = MetricEncoder(batch_size=256, max_steps=4, n_permutations=2, random_seed=3)
        fi, _ = e.fit(X.planted(spark, sf)).score()
        return weights_of(e), fi.toPandas().sort_values(["feature", "permutation"]).importance.to_numpy()

    w0, i0 = run()
    conf("spark.sql.shuffle.partitions", 7)
    conf(BROADCAST_BYTES_KEY, 100)
    conf(GROUP_ROWS_KEY, 50)
    w1, i1 = run()
    np.testing.assert_allclose(w0, w1, atol=1e-12)
    np.testing.assert_allclose(i0, i1, atol=1e-12)


def test_no_seed_differs_between_calls(spark, sf):
    encoder = MetricEncoder(batch_size=128, max_steps=2, n_permutations=1).fit(X.planted(spark, sf))
    a, b = (encoder.score()[0].agg(F.sum("permuted")).first()[0] for _ in range(2))
    assert a != b


def test_golden_importances(spark, sf, conf):
    # The golden values are of md5 draws.
    conf(DRAWS_KEY, MD5)
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = importance_table(source, (0.8847, 0.4423, 0.1474), 5120, 1, stream="42", digits=9)
    got = {r["feature"]: r for r in out.collect()}
    want = {
        "f1": (0.999999868, 0.474676451),
        "f2": (0.999999935, 0.423668700),
        "f3": (0.999999921, 0.158187679),
    }
    for f, (base, imp) in want.items():
        assert got[f]["baseline"] == pytest.approx(base, abs=2e-9)
        assert got[f]["importance"] == pytest.approx(imp, abs=2e-9)


def test_stepwise_solver(spark, sf):
    source = X.planted(spark, sf)
    encoder = MetricEncoder(batch_size=512, max_steps=250, solver="steps", random_seed=1, patience=50)
    encoder.fit(source)
    assert weights_of(encoder) @ WANT > 0.999
    early = MetricEncoder(batch_size=512, max_steps=250, solver="steps", random_seed=1, patience=1)
    assert early.fit(source).fit_.steps < encoder.fit_.steps


def noisy(spark, sf, scale):
    source = X.planted(spark, sf)
    noise = (F.xxhash64("c_custkey") % 1000 / 1000.0) * scale
    return Stimuli(
        source.df.withColumn("y", F.concat("y", F.array(noise))), source.columns, "y", "c_custkey",
        categorical=["f3", "f4"], dense=True,
    )


def test_recovery_under_noise(spark, sf):
    encoder = MetricEncoder(batch_size=2048, max_steps=20, random_seed=1).fit(noisy(spark, sf, 0.2))
    assert weights_of(encoder) @ WANT > 0.98


def interaction_matrix(spark, n=40):
    rng = np.random.default_rng(0)
    v, s = rng.uniform(size=n), rng.integers(0, 3, n)
    g = np.abs(v[:, None] - v)
    m = (s[:, None] != s).astype(float)
    y = np.sqrt(0.5 * g * g + 0.3 * g * m + 0.3 * m * m)
    i, j = np.indices((n, n))
    pdf = pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": g.ravel(), "m": m.ravel(), "y": y.ravel()})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("complete", [True, False])
def test_precomputed_with_interactions(spark, complete):
    source = PrecomputedPairs(interaction_matrix(spark), ["g", "m"], "y", complete=complete)
    encoder = MetricEncoder(
        distance="precomputed", interactions=True, batch_size=4096, max_steps=5, n_permutations=2,
        random_seed=1,
    ).fit(source)
    got = {(r["row_feature"], r["col_feature"]): r["weight"] for r in encoder.get_weights().collect()}
    assert got["g", "g"] == pytest.approx(0.6934, abs=1e-3)
    assert got["m", "g"] == pytest.approx(0.4160, abs=1e-3)
    assert got["m", "m"] == pytest.approx(0.4160, abs=1e-3)
    square = square_weights(encoder.get_weights(), ["g", "m"]).orderBy("row_feature").collect()
    assert square[0]["m"] is None and square[1]["g"] == got["m", "g"]
    importances, _ = encoder.score()
    assert {r["feature"] for r in importances.collect()} == {"g", "m x g", "m"}
    plain = MetricEncoder(distance="precomputed", batch_size=4096, max_steps=5, random_seed=1).fit(source)
    assert plain.fit_.correlation < encoder.fit_.correlation


def test_interaction_fit_on_stimuli(spark, sf):
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    encoder = MetricEncoder(interactions=True, batch_size=2048, max_steps=8, n_permutations=1, random_seed=1)
    w = encoder.fit(source).fit_.weights
    m = np.zeros((3, 3))
    m[np.tril_indices(3)] = w
    m = m + np.tril(m, -1).T
    assert np.linalg.norm(m) == pytest.approx(1) and np.linalg.eigvalsh(m)[0] > -1e-9
    np.testing.assert_allclose(np.diag(m), WANT[:3], atol=0.02)
    assert encoder.score()[0].count() == 6


def test_scores_of_a_small_batch_by_brute_force(spark, sf):
    source = X.planted(spark, sf, ("f1", "f2"))
    out = importance_table(source, (0.8, 0.6), 64, 2, stream="b").toPandas()
    dist = source.distances(sample_pairs(source, 64, 4, "b"), 256).toPandas().sort_values("pair_id")
    x = np.stack(dist.x.to_numpy())
    pred = (x @ np.array([0.8, 0.6])).astype(np.float32)
    for trial in range(4):
        rows = (dist.trial == trial).to_numpy()
        ranks = [np.argsort(np.argsort(v[rows], kind="stable")) for v in (pred, dist.d.to_numpy().astype(np.float32))]
        feature, k = ("f1", "f2")[trial // 2], trial % 2
        got = out[(out.feature == feature) & (out.permutation == k)].baseline.iloc[0]
        assert got == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-6)


def test_held_out_and_folds(spark, sf):
    source = X.planted(spark, sf)
    encoder = MetricEncoder(batch_size=256, max_steps=4, n_permutations=2, random_seed=1)
    fi, s = holdout(encoder, source, 75, 5)
    assert fi.count() == 8 and s.count() == 8
    fi, s = cross_validate(encoder, source, 3, 5)
    assert {r["split"] for r in fi.select("split").distinct().collect()} == {0, 1, 2}
    assert fi.count() == 24 and s.count() == 24


def test_splits_partition_the_rows(spark):
    df = spark.range(1000)
    train, test = train_test_split(df, "id", 75, 1)
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 1000
    assert abs(train.count() - 750) < 60
    sizes = [r["count"] for r in with_fold(df, 4, "id", 1).groupBy("fold").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 1000


def test_scoring_other_data_checks_and_orders_features(spark, sf):
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    encoder = MetricEncoder(batch_size=256, max_steps=4, n_permutations=1, random_seed=1).fit(source)
    swapped = X.planted(spark, sf, ("f3", "f1", "f2"))
    a = {r["feature"]: r["baseline"] for r in encoder.score(swapped)[0].collect()}
    assert min(a.values()) > 0.999
    with pytest.raises(ValueError):
        encoder.score(X.planted(spark, sf, ("f1", "f2")))


def test_calls_out_of_order_and_wrong_arguments(spark, sf):
    for call in ("score", "get_weights"):
        with pytest.raises(RuntimeError):
            getattr(MetricEncoder(), call)()
    with pytest.raises(ValueError):
        MetricEncoder(distance="hamming")
    with pytest.raises(ValueError):
        MetricEncoder(solver="newton")
    with pytest.raises(ValueError):
        MetricEncoder(factor=1.0)
    with pytest.raises(ValueError):
        MetricEncoder(distance="precomputed").fit(X.planted(spark, sf))


def test_single_feature_and_permutation(spark, sf):
    source = X.planted(spark, sf, ("f1",))
    encoder = MetricEncoder(batch_size=128, max_steps=2, n_permutations=1, random_seed=1).fit(source)
    assert weights_of(encoder) == pytest.approx([1.0])
    assert encoder.score()[0].count() == 1


def test_score_variation_warning_and_batch_size_order(spark, sf):
    source = noisy(spark, sf, 3.0)
    encoder = MetricEncoder(batch_size=32, max_steps=4, n_permutations=2, random_seed=1).fit(source)
    with pytest.warns(UserWarning, match="vary"):
        encoder.score(warning_threshold=0.001)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fi, _ = encoder.score(warning_threshold=1, batch_size=64)
    assert {r["n"] for r in fi.collect()} == {64}


def test_estimated_batch_size_is_used(spark, sf):
    source = X.planted(spark, sf, ("f1", "f2"))
    encoder = MetricEncoder(threshold=0.2, n_trials=4, max_steps=2, n_permutations=1, random_seed=1)
    size = encoder.estimate_batch_size(source)
    encoder.fit(source)
    assert encoder.batch_size_fit_ == size
    assert {r["n"] for r in encoder.score()[0].collect()} == {size}


def test_smoke_table(spark):
    """Ten two-valued string features, a random vector of 32, tiny batches."""
    rng = np.random.default_rng(0)
    rows = [
        (k, *rng.choice(["A", "B"], 10).tolist(), rng.normal(size=32).tolist()) for k in range(1024)
    ]
    names = [str(k) for k in range(10)]
    schema = "id bigint, " + ", ".join(f"`{c}` string" for c in names) + ", y array<double>"
    source = Stimuli(spark.createDataFrame(rows, schema), names, "y", "id", dense=True)
    encoder = MetricEncoder(batch_size=32, max_steps=5, solver="steps", random_seed=0).fit(source)
    fi, s = encoder.score(warning_threshold=1)
    assert encoder.wide(fi).count() == 5 and len(encoder.wide(fi).columns) == 11 and s.count() == 50


def test_predict(spark, sf):
    source = X.planted(spark, sf, ("f1", "f2"))
    encoder = MetricEncoder(batch_size=128, max_steps=2, random_seed=1).fit(source)
    out = encoder.predict(source.distances(sample_pairs(source, 10, 1, "p"), 10)).toPandas()
    np.testing.assert_allclose(out.prediction, np.stack(out.x.to_numpy()) @ encoder.fit_.weights)


def test_many_features_with_interactions(spark):
    """Eleven features make 66 terms: array functions and late products."""
    rng = np.random.default_rng(0)
    v = rng.uniform(size=(80, 11))
    rows = [(k, *map(float, v[k]), [float(u) for u in v[k] * np.sqrt(np.arange(1, 12))]) for k in range(80)]
    names = [f"c{k}" for k in range(11)]
    schema = "id bigint, " + ", ".join(f"{c} double" for c in names) + ", y array<double>"
    source = Stimuli(spark.createDataFrame(rows, schema), names, "y", "id", dense=True)
    encoder = MetricEncoder(interactions=True, batch_size=6400, max_steps=1, n_permutations=1, random_seed=1)
    w = encoder.fit(source).fit_.weights
    assert len(w) == 66 and encoder.fit_.correlation > 0.99
    pdf = encoder.score(batch_size=400)[0].toPandas()
    assert len(pdf) == 66 and pdf.baseline.mean() > 0.95
    few = importance_table(source, w, 50, 1, interactions=True, stream="w").toPandas()
    pairs = sample_pairs(source, 50, 66, "w")
    dist = source.distances(pairs, 3300, "euclidean", True).toPandas().sort_values("pair_id")
    x, first = np.stack(dist.x.to_numpy()), (dist.trial == 5).to_numpy()
    pred = (x @ w).astype(np.float32)[first]
    ranks = [np.argsort(np.argsort(t, kind="stable")) for t in (pred, dist.d.to_numpy().astype(np.float32)[first])]
    got = few[few.feature == encoder.term_names[5]].baseline.iloc[0]
    assert got == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=5e-3)
