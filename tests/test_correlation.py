import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica.operators import moments as M
from dyadica.operators.correlation import (
    pearson, pearson_eps, prefix_correlations, spearman, stability,
)


def table(spark, q, n=200, groups=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(size=(n, q))
    d = x @ rng.uniform(size=q) + rng.normal(size=n) * 0.1 + 5
    rows = [(k % groups, k, [float(v) for v in x[k]], float(d[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "trial bigint, pair_id bigint, x array<double>, d double")
    return df.repartition(5), x, d


def test_pearson(spark):
    df, x, d = table(spark, 2)
    row = df.agg(
        pearson(F.get("x", F.lit(0)), F.col("d")).alias("a"),
        pearson_eps(F.get("x", F.lit(0)), F.col("d")).alias("b"),
        pearson_eps(F.lit(1.0), F.col("d")).alias("c"),
    ).first()
    want = np.corrcoef(x[:, 0], d)[0, 1]
    assert row["a"] == pytest.approx(want) and row["b"] == pytest.approx(want, abs=1e-6)
    assert row["c"] == 0.0


@pytest.mark.parametrize("ties", ["ordinal", "average"])
def test_spearman(spark, ties):
    df, x, d = table(spark, 1, groups=1)
    df = df.select("trial", "pair_id", F.round(F.get("x", F.lit(0)), 1).alias("p"), "d")
    got = spearman(df, "trial", "p", "d", "pair_id", 200, ties).first()["spearman"]
    p = np.round(x[:, 0], 1)
    if ties == "ordinal":
        rank = np.argsort(np.argsort(p, kind="stable"), kind="stable")
    else:
        rank = np.array([(p < v).sum() + ((p == v).sum() - 1) / 2 for v in p])
    assert got == pytest.approx(np.corrcoef(rank, d.argsort().argsort())[0, 1], abs=1e-6)
    grown = df.withColumn("d", F.exp("d"))
    assert spearman(grown, "trial", "p", "d", "pair_id", 200, ties).first()["spearman"] == pytest.approx(got)


def test_unknown_tie_rule(spark):
    df, _, _ = table(spark, 1)
    with pytest.raises(ValueError):
        spearman(df.withColumn("p", F.col("d")), "trial", "p", "d", "pair_id", 200, "dense")


@pytest.mark.parametrize("q", [3, M.EXPRESSION_COLUMNS + 4])
@pytest.mark.parametrize("by", [None, "trial"])
def test_moments_match_numpy(spark, q, by):
    df, x, d = table(spark, q)
    wide = df.withColumn("d2", F.col("d") * F.col("d"))
    vectors = M.moment_vectors(wide, q, ("d", "d2"), (by,) if by else ())
    got = M.collect_moments(vectors, q + 2, by)
    full = np.column_stack([x, d, d * d])
    for g in range(3) if by else [0]:
        rows = np.arange(len(x)) % 3 == g if by else np.ones(len(x), bool)
        part = full[rows]
        m = got[g]
        assert m.n == len(part)
        np.testing.assert_allclose(m.cov, np.cov(part.T, bias=True), atol=1e-9)
        np.testing.assert_allclose([m.low, m.high, m.top], [d[rows].min(), d[rows].max(), x[rows].max()])


def test_scaled_square_moments(spark):
    df, x, d = table(spark, 3)
    wide = df.withColumn("d2", F.col("d") * F.col("d"))
    m = M.collect_moments(M.moment_vectors(wide, 3, ("d", "d2")), 5)[0]
    sigma, c, var = M.scaled_square_moments(m, 3, m.low, m.high, 1e-8)
    s = ((d - d.min()) / (d.max() - d.min() + 1e-8)) ** 2
    want = np.cov(np.column_stack([x, s]).T, bias=True)
    np.testing.assert_allclose(sigma, want[:3, :3], atol=1e-12)
    np.testing.assert_allclose(c, want[:3, 3], atol=1e-10)
    assert var == pytest.approx(want[3, 3], abs=1e-10)


@pytest.mark.parametrize("q", [4, M.EXPRESSION_COLUMNS + 3])
def test_prefix_correlations(spark, q):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(120, q))
    rows = [(k // 60, int(k % 60 >= 20), [float(v) for v in x[k]]) for k in range(120)]
    df = spark.createDataFrame(rows, "trial bigint, step int, x array<double>")
    corr = prefix_correlations(M.moment_vectors(df, q, by=("trial", "step")), q)
    got = {(r["trial"], r["step"], r["a"], r["b"]): r["corr"] for r in corr.collect()}
    assert len(got) == 2 * 2 * q * (q - 1) // 2
    table_ = {}
    for (t, s, a, b), v in got.items():
        part = x[t * 60 : t * 60 + (20 if s == 0 else 60)]
        assert v == pytest.approx(np.corrcoef(part[:, a], part[:, b])[0, 1], abs=1e-6)
        table_.setdefault((s, a, b), []).append(v)
    for r in stability(corr).collect():
        values = [v for (s, _, _), v in table_.items() if s == r["step"]]
        assert r["max_std"] == pytest.approx(max(np.std(v, ddof=1) for v in values))
        assert r["max_corr"] == pytest.approx(max(abs(np.mean(v)) for v in values))
