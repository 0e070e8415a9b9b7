import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadica import PrecomputedPairs, Stimuli
from dyadica.functions.distances import LARGEST_SINGLE, distance_terms, resolve_metric, term_names, terms_array
from dyadica.operators.pairs import sample_pairs
from dyadica.operators.scaling import minmax_square_distances


def vectors(n=30, h=5, seed=0):
    return np.random.default_rng(seed).normal(size=(n, h))


def source_of(spark, y, **kw):
    rows = [(k, float(k % 4), [float(v) for v in row]) for k, row in enumerate(y)]
    df = spark.createDataFrame(rows, "id bigint, v double, y array<double>")
    return Stimuli(df, ["v"], "y", "id", dense=True, **kw)


BRUTE = {
    "euclidean": lambda a, b: np.linalg.norm(a - b),
    "manhattan": lambda a, b: np.abs(a - b).sum(),
    "cosine": lambda a, b: 1 - a @ b / (max(np.linalg.norm(a), 1e-8) * max(np.linalg.norm(b), 1e-8)),
    "norm_diff": lambda a, b: abs(np.linalg.norm(a) - np.linalg.norm(b)),
}


@pytest.mark.parametrize("name", BRUTE)
def test_named_metrics(spark, name):
    y = vectors()
    y[3] = 0.0
    source = source_of(spark, y)
    rows = source.distances(sample_pairs(source, 200, 1, "m"), 200, name).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["d"] == pytest.approx(BRUTE[name](y[r["i"]], y[r["j"]]), abs=1e-12)
        if r["i"] == r["j"] and r["i"] != 3:
            assert r["d"] == pytest.approx(0, abs=1e-12)
        if name == "cosine" and 3 in (r["i"], r["j"]):
            assert r["d"] == 1.0


def test_custom_column_and_pandas_udf(spark):
    y = vectors()
    source = source_of(spark, y)
    pairs = sample_pairs(source, 50, 1, "m")

    @F.pandas_udf("double")
    def largest(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.abs(u - v).max()) for u, v in zip(a, b)])

    def largest_column(a, b):
        return F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v)))

    for fn in (largest, largest_column):
        for r in source.distances(pairs, 50, fn).collect():
            assert r["d"] == pytest.approx(np.abs(y[r["i"]] - y[r["j"]]).max())


def test_unknown_metric():
    with pytest.raises(ValueError):
        resolve_metric("hamming")


def by_pair(source, n, **kw):
    out = source.distances(sample_pairs(source, n, 1, "m"), n, **kw)
    return {(r["i"], r["j"]): r for r in out.collect()}


@pytest.mark.parametrize("fill,want", [(0.0, 0.0), (1.0, 1.0), (-3.0, 1.0), (0.5, 0.25)])
def test_missing_values(spark, fill, want):
    df = spark.createDataFrame(
        [(0, 0.0, "a"), (1, None, "b"), (2, float("nan"), None), (3, 1.0, "a")],
        "id bigint, v double, s string",
    )
    source = Stimuli(df, ["v", "s"], None, "id", dense=True)
    got = by_pair(source, 300, distance=None, nan_to_num=fill)
    assert len(got) == 16
    for (i, j), r in got.items():
        x = r["x"]
        assert x[0] == (want if {i, j} & {1, 2} else float(i != j))
        assert x[1] == (want if 2 in (i, j) else float({i, j} & {0, 3} != {i, j} and i != j))


def test_raw_features_are_clipped_not_scaled(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 0.25]), (1, [5.0, 0.75]), (2, [math.inf, 0.0])], "id bigint, x array<double>"
    )
    source = Stimuli(df, "x", None, "id", dense=True)
    assert source.feature_names == ["feature_0", "feature_1"]
    got = by_pair(source, 200, distance=None)
    assert got[0, 1]["x"] == [1.0, 0.25] and got[0, 2]["x"][0] == 1.0 and got[2, 2]["x"][0] == 0.0


def test_scalar_nested_and_column_targets(spark):
    df = spark.createDataFrame(
        [(0, 1.0, [[1.0, 2.0], [3.0, 4.0]]), (1, 3.5, [[1.0, 1.0], [0.0, 4.0]])],
        "id bigint, t double, y array<array<double>>",
    )
    made = [("t", 2.5), ("y", 4.0), (["t", "y"], 6.5)]
    for target, want in made:
        source = Stimuli(df, ["t"], target, "id", dense=True)
        assert by_pair(source, 40, distance="manhattan")[0, 1]["d"] == want
    with pytest.raises(TypeError):
        s = Stimuli(df.withColumn("c", F.lit("x")), ["t"], "c", "id", dense=True)
        s.distances(sample_pairs(s, 2), 2)


def test_missing_and_infinite_representations(spark):
    df = spark.createDataFrame(
        [(0, [0.0]), (1, None), (2, [float("nan")]), (3, [math.inf])], "id bigint, y array<double>"
    ).withColumn("v", F.col("id"))
    got = by_pair(Stimuli(df, ["v"], "y", "id", dense=True), 300, nan_to_num=0.25)
    assert got[0, 1]["d"] == 0.25 and got[2, 0]["d"] == 0.25
    assert got[0, 3]["d"] == LARGEST_SINGLE and got[3, 3]["d"] == 0.25


def test_ragged_vectors_fail(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0, 2.0])], "id bigint, y array<double>").withColumn("v", F.col("id"))
    source = Stimuli(df, ["v"], "y", "id", dense=True)
    with pytest.raises(Exception, match="differ in length"):
        source.distances(sample_pairs(source, 40), 40).collect()


def test_terms_and_names(spark):
    assert term_names(["a", "b", "c"], True) == ["a", "b x a", "b", "c x a", "c x b", "c"]
    assert term_names(["a", "b"], False) == ["a", "b"]
    row = spark.range(1).select(F.array(*distance_terms([F.lit(2.0), F.lit(3.0)], True)).alias("x")).first()
    assert row["x"] == [4.0, 6.0, 9.0]


def test_wide_terms_equal_narrow_ones(spark):
    d = [F.lit(float(k + 1)) for k in range(12)]
    row = spark.range(1).select(
        terms_array(d, True).alias("wide"), F.array(*distance_terms(d, True)).alias("narrow")
    ).first()
    assert len(row["wide"]) == 78 and row["wide"] == row["narrow"]


def matrix(spark, n=6):
    rows = [(i, j, [abs(i - j) * 1.0, float(i % 2 != j % 2)], float(abs(i - j)) ** 0.5) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "i bigint, j bigint, x array<double>, y double")


@pytest.mark.parametrize("complete", [True, False])
@pytest.mark.parametrize("mode", ["lookup", "ends", "semi", "shuffle"])
def test_precomputed(spark, complete, mode):
    source = PrecomputedPairs(matrix(spark), "x", "y", complete=complete)
    pairs = sample_pairs(source, 80, 1, "m")
    rows = source.distances(pairs, 80, interactions=True, mode=mode).collect()
    assert len(rows) == 80 and source.size() == (6 if complete else 36)
    for r in rows:
        g, m = abs(r["i"] - r["j"]), float(r["i"] % 2 != r["j"] % 2)
        assert r["x"] == [g * g, m * g, m * m] and r["d"] == pytest.approx(g**0.5)


def test_precomputed_checks(spark):
    df = matrix(spark)
    with pytest.raises(ValueError):
        PrecomputedPairs(df.filter("NOT (i = 2 AND j = 3)"), "x", "y").size()
    with pytest.raises(ValueError):
        PrecomputedPairs(df.unionByName(df), "x", "y", complete=False).size()
    with pytest.raises(ValueError):
        PrecomputedPairs(df, "x", "absent")
    with pytest.raises(ValueError):
        PrecomputedPairs(df, "x").distances(sample_pairs(PrecomputedPairs(df, "x"), 2), 2)


def test_running_bounds(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0), (0, 1, 3.0), (1, 2, 0.0), (1, 3, 2.0), (2, 4, 9.0)], "trial bigint, pair_id bigint, d double"
    )
    got = {r["pair_id"]: r["s"] for r in minmax_square_distances(df).collect()}
    want = {0: 0.0, 1: 1.0, 2: 0.0, 3: (2 / 3) ** 2, 4: 1.0}
    assert got == pytest.approx(want, abs=1e-7)
