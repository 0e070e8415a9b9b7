import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica import MetricEncoder, Stimuli
from dyadica.plans.batch_size import candidate_sizes, estimate_batch_size, size_stability
from tests.test_pairs import drawn


def source_of(spark, n=200, copy=False):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(size=n), rng.uniform(size=n)
    rows = [(k, float(a[k]), float(a[k] if copy else b[k]), "xyz"[k % 3]) for k in range(n)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, s string")
    return Stimuli(df, ["a", "b", "s"], None, "id", dense=True), a, b


def test_schedule():
    sizes, last = candidate_sizes(256, 2**20, 1.2)
    assert len(sizes) == 46 and sizes[:3] == [256, 307, 368] and last == 1114060
    assert candidate_sizes(4, 8, 1.2) == ([4, 5, 6, 7], 8)
    assert candidate_sizes(10, 10, 2.0) == ([], 10)
    with pytest.raises(ValueError):
        candidate_sizes(4, 8, 1.0)


def test_stability_by_brute_force(spark):
    source, a, b = source_of(spark)
    sizes, trials, stride = [50, 120], 3, 1000
    got = {r["batch_size"]: r for r in size_stability(source, sizes, trials, stride, "t").collect()}
    span = lambda v: (v - v.min()) / (v.max() - v.min())
    a, b = span(a), span(b)
    for size in sizes:
        corrs = []
        for t in range(trials):
            ids = [t * stride + k for k in range(size)]
            i = np.array([drawn("t", p)[0] % 200 for p in ids])
            j = np.array([drawn("t", p)[1] % 200 for p in ids])
            x = np.column_stack([(a[i] - a[j]) ** 2, (b[i] - b[j]) ** 2, (i % 3 != j % 3) * 1.0])
            c = np.corrcoef(x.T)
            corrs.append([c[1, 0], c[2, 0], c[2, 1]])
        corrs = np.array(corrs)
        assert got[size]["max_std"] == pytest.approx(corrs.std(axis=0, ddof=1).max(), abs=1e-6)
        assert got[size]["max_corr"] == pytest.approx(np.abs(corrs.mean(axis=0)).max(), abs=1e-6)


def test_estimate_stops_at_the_first_stable_size(spark):
    source, _, _ = source_of(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = estimate_batch_size(source, 64, 8, 0.05, 1.5, 4000, stream="t")
    sizes, _ = candidate_sizes(64, 4000, 1.5)
    table = sorted(
        (r["batch_size"], r["max_std"]) for r in size_stability(source, sizes, 8, 4000, "t").collect()
    )
    assert got == next(b for b, sd in table if sd < 0.05)


def test_warnings(spark):
    source, _, _ = source_of(spark, copy=True)
    with pytest.warns(UserWarning, match="correlate"):
        estimate_batch_size(source, 64, 4, 0.5, 2.0, 1000)
    source, _, _ = source_of(spark)
    with pytest.warns(UserWarning, match="was stable"):
        assert estimate_batch_size(source, 64, 4, 1e-9, 2.0, 200) == 256
    with pytest.warns(UserWarning, match="was stable"):
        assert estimate_batch_size(source, 64, 4, 1e-9, 2.0, 64) == 64


def test_one_feature(spark):
    source, _, _ = source_of(spark)
    one = Stimuli(source.df, ["a"], None, "id", dense=True)
    assert MetricEncoder().estimate_batch_size(one) == 256


def test_missing_fill_reaches_the_estimate(spark):
    df = spark.range(50).select("id", F.lit(None).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    source = Stimuli(df, ["a", "b"], None, "id", dense=True)
    row = size_stability(source, [50], 2, 50, "t", nan_to_num=1.0).first()
    assert row["max_std"] == 0.0
