import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import fixtures as X
from dyadica import MetricEncoder, PrecomputedPairs, Stimuli
from dyadica.functions import kernels as K
from dyadica.operators.moments import collect_moments, moment_vectors
from dyadica.operators.pairs import counted_pairs, sample_pair_range, sample_pairs
from dyadica.plans.fit import fit_pooled


def vectors(spark, rows, width=3):
    return Stimuli(
        spark.createDataFrame([(k, float(k % 5), v) for k, v in enumerate(rows)], "id long, f double, y array<double>"),
        ["f"], "y", "id", dense=True,
    )


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_kernels_give_the_digits_of_the_expressions(spark, metric):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(40, 17)).tolist()
    rows[3], rows[4][5], rows[6][2], rows[7][1] = None, None, float("nan"), float("inf")
    rows[8] = [0.0] * 17
    source = vectors(spark, rows)
    pairs = sample_pairs(source, 800, 1, "s")
    by_kernel = source.distances(pairs, 800, metric)
    assert "MapInArrow" in by_kernel._jdf.queryExecution().toString()
    plain = source.distances(pairs, 800, metric, mode="lookup")
    assert "MapInArrow" not in plain._jdf.queryExecution().toString()
    assert by_kernel.columns == plain.columns
    assert sorted(by_kernel.collect()) == sorted(plain.collect())


def test_kernels_need_one_length_and_room(spark, monkeypatch):
    ragged = vectors(spark, [[1.0, 2.0], [1.0], [3.0, 4.0]])
    assert ragged.matrix() is None
    assert vectors(spark, [None, None]).matrix() is None
    monkeypatch.setattr(K, "KERNEL_BYTES", 100)
    assert vectors(spark, [[1.0] * 20] * 10).matrix() is None
    pairs = sample_pairs(vectors(spark, [[1.0] * 20] * 10), 5, 1, "s")
    assert vectors(spark, [[1.0] * 20] * 10).distances(pairs, 5).filter("d = 0").count() == 5


@pytest.mark.parametrize("cells", [1 << 22, 10])
def test_counts_are_those_of_the_draws(spark, monkeypatch, cells):
    monkeypatch.setattr("dyadica.operators.pairs.COUNTED_CELLS", cells)
    source = vectors(spark, [[float(k)] for k in range(9)])
    assert counted_pairs(source, 2 * 81 - 1, 50, "s") is None
    counted = counted_pairs(source, 4000, 50, "s")
    want = sample_pair_range(source, 0, 4000, 50, "s").groupBy("i", "j").agg(F.count("*").alias("times"))
    assert counted.columns == ["i", "j", "times"]
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect())) and counted.count() == 81


@pytest.mark.parametrize("interactions", [False, True])
@pytest.mark.parametrize("columns", [2, 6])
def test_counted_fit_equals_the_plain_one(spark, monkeypatch, interactions, columns):
    rng = np.random.default_rng(2)
    n = 25
    x, y = rng.uniform(size=(n, columns)), rng.normal(size=(n, 4))
    y[:, :2] += 3 * x[:, :2]
    rows = [(k, *map(float, x[k]), y[k].tolist()) for k in range(n)]
    names = [f"c{k}" for k in range(columns)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names) + ", y array<double>")
    source = Stimuli(df, names, "y", "id", dense=True)
    counted = fit_pooled(source, "euclidean", interactions, 0.0, 4000, 500, "s")
    monkeypatch.setattr("dyadica.operators.pairs.COUNTED_DRAWS", 1e9)
    plain = fit_pooled(source, "euclidean", interactions, 0.0, 4000, 500, "s")
    assert counted.n_pairs == plain.n_pairs == 4000
    assert counted.weights == pytest.approx(plain.weights, abs=1e-9 if interactions else 1e-12)
    assert counted.correlation == pytest.approx(plain.correlation, abs=1e-12)


@pytest.mark.parametrize("q", [2, 14])
def test_weighted_moments_by_repetition(spark, q):
    rng = np.random.default_rng(3)
    rows = [(int(g), rng.normal(size=q).tolist(), float(rng.normal()), int(t)) for g, t in zip(rng.integers(0, 3, 60), rng.integers(1, 5, 60))]
    df = spark.createDataFrame(rows, "g int, x array<double>, d double, times long")
    often = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    centre = rng.normal(size=q + 1)
    a = collect_moments(moment_vectors(df, q, ("d",), ("g",), None, centre, "times"), q + 1, "g")
    b = collect_moments(moment_vectors(often, q, ("d",), ("g",), None, centre), q + 1, "g")
    for g in a:
        assert (a[g].n, a[g].low, a[g].high, a[g].top) == (b[g].n, b[g].low, b[g].high, b[g].top)
        assert a[g].mean == pytest.approx(b[g].mean, abs=1e-12) and a[g].cov == pytest.approx(b[g].cov, abs=1e-12)


def test_a_complete_matrix_counts_its_draws_too(spark, monkeypatch):
    n = 8
    rows = [(i, j, abs(i - j) / n, float(i % 3 != j % 3), (abs(i - j) / n) ** 0.7 + 0.2 * (i % 3 != j % 3)) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "i long, j long, a double, b double, y double")
    encoder = MetricEncoder(batch_size=400, max_steps=10, distance="precomputed", random_seed=3)
    counted = encoder.fit(PrecomputedPairs(df, ["a", "b"], "y")).fit_
    monkeypatch.setattr("dyadica.operators.pairs.COUNTED_DRAWS", 1e9)
    plain = encoder.fit(PrecomputedPairs(df, ["a", "b"], "y")).fit_
    assert counted.weights == pytest.approx(plain.weights, abs=1e-12) and counted.n_pairs == 4000


def test_fit_of_the_planted_customers_is_counted_or_not_alike(spark, sf, monkeypatch):
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    n = source.size()
    counted = fit_pooled(source, "euclidean", False, 0.0, 3 * n * n, n, "s")
    monkeypatch.setattr("dyadica.operators.pairs.COUNTED_DRAWS", 1e9)
    plain = fit_pooled(source, "euclidean", False, 0.0, 3 * n * n, n, "s")
    assert counted.weights == pytest.approx(plain.weights, abs=1e-12)
