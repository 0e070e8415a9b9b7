import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica.operators.ranks import (
    average_rank, ordinal_position, pooled, rank_value, shuffle_within, soft_rank, soft_rank_affine,
)
from dyadica.plans.importance import importance_table
from dyadica.session import BROADCAST_BYTES_KEY, GROUP_ROWS_KEY, broadcast_bytes, group_rows, release, written
from dyadica.sources.sizing import fits_broadcast
from dyadica.sources.stimuli import Stimuli


def batch(spark, n=60, groups=3, distinct=5):
    """Batches where one value holds a third of the rows."""
    return spark.range(n * groups).select(
        F.col("id").alias("pair_id"),
        F.expr(f"id div {n}").alias("trial"),
        F.when(F.col("id") % 3 == 0, F.lit(2.0)).otherwise((F.col("id") * 7 % distinct).cast("double")).alias("v"),
    )


def local(df):
    return df.toPandas().sort_values("pair_id")


def want_ordinal(pdf):
    out = {}
    for _, g in pdf.groupby("trial"):
        order = g.sort_values(["v", "pair_id"]).pair_id
        out.update({p: k for k, p in enumerate(order)})
    return out


@pytest.mark.parametrize("limit", [1000, 10])
def test_ordinal(spark, conf, limit):
    conf(GROUP_ROWS_KEY, limit)
    df = batch(spark)
    got = local(ordinal_position(df, "trial", ["v", "pair_id"], "r", 60))
    assert dict(zip(got.pair_id, got.r)) == want_ordinal(local(df))


@pytest.mark.parametrize("limit,size", [(1000, 10**8), (10, 10**8), (10, 50)])
def test_average(spark, conf, limit, size):
    conf(GROUP_ROWS_KEY, limit)
    conf(BROADCAST_BYTES_KEY, size)
    df = batch(spark)
    got = local(average_rank(df, "trial", "v", "pair_id", "r", 60))
    want = local(df).groupby("trial").v.rank() - 1
    np.testing.assert_allclose(got.r.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("limit", [1000, 10])
def test_shuffle_within(spark, conf, limit):
    conf(GROUP_ROWS_KEY, limit)
    df = batch(spark, distinct=50)
    got = local(shuffle_within(df, "trial", "v", "s", "moved", 60))
    assert len(got) == 180 and list(got.v) == list(local(df).v)
    for _, g in got.groupby("trial"):
        assert sorted(g.v) == sorted(g.moved) and list(g.v) != list(g.moved)


def test_shuffle_does_not_depend_on_the_path(spark, conf):
    df = batch(spark, distinct=50)
    a = local(shuffle_within(df, "trial", "v", "s", "moved", 60))
    conf(GROUP_ROWS_KEY, 10)
    b = local(shuffle_within(df.repartition(7), "trial", "v", "s", "moved", 60))
    assert list(a.moved) == list(b.moved)


def test_one_shuffle_for_permutation_and_ranks(spark):
    df = shuffle_within(batch(spark), "trial", "v", "s", "moved", 60)
    df = ordinal_position(df, "trial", ["moved", "pair_id"], "r", 60)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_last_bit_noise_does_not_split_ties(spark):
    df = spark.range(1).select(
        (rank_value(F.lit(0.1) + F.lit(0.2)) == rank_value(F.lit(0.3))).alias("single"),
        (rank_value(F.lit(0.1) + F.lit(0.2), 9) == rank_value(F.lit(0.3), 9)).alias("digits"),
        (rank_value(F.lit(1e-12)) == rank_value(F.lit(2e-12))).alias("small"),
    ).first()
    assert df["single"] and df["digits"] and not df["small"]


def frame(spark, v, n_groups=1):
    rows = [(g, k, float(x)) for g in range(n_groups) for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "trial bigint, pair_id bigint, v double")


def test_soft_rank_affine_regime(spark):
    v = np.random.default_rng(0).uniform(0, 3, 40)
    df = frame(spark, v, 2)
    a = local(soft_rank_affine(df, "trial", "v", "s"))
    b = local(soft_rank(df, "trial", "v", "pair_id", "s", 40))
    want = np.concatenate([v - v.mean() + 20.5] * 2)
    a, b = (x.sort_values(["trial", "pair_id"]).s.to_numpy() for x in (a, b))
    np.testing.assert_allclose(a, want)
    np.testing.assert_allclose(b, want)


def test_soft_rank_beyond_it(spark, conf):
    v = np.random.default_rng(0).permutation(20) * 100.0
    df = frame(spark, v)
    got = local(soft_rank(df, "trial", "v", "pair_id", "s", 20)).s.to_numpy()
    np.testing.assert_allclose(got, v.argsort().argsort() + 1)
    with pytest.raises(Exception, match="half the batch"):
        soft_rank_affine(df, "trial", "v", "s").collect()
    mixed = np.random.default_rng(1).uniform(0, 30, 20)
    s = local(soft_rank(frame(spark, mixed), "trial", "v", "pair_id", "s", 20)).s.to_numpy()
    assert s.sum() == pytest.approx(210)
    assert (np.diff(s[mixed.argsort()]) >= -1e-9).all()
    top = np.sort(s)[::-1].cumsum()
    assert (top <= np.arange(20, 0, -1).cumsum() + 1e-9).all()


@pytest.mark.parametrize("kind", ["spread", "narrow", "mixed", "equal", "steps", "long"])
def test_soft_rank_of_large_batches(spark, conf, kind):
    rng = np.random.default_rng(2)
    n = 120
    v = {
        "spread": rng.permutation(n) * 100.0, "narrow": rng.uniform(0, 3, n), "equal": np.full(n, 2.5),
        "mixed": np.where(rng.uniform(size=n) < 0.5, rng.uniform(0, 30, n), rng.uniform(0, 200, n)),
        "steps": np.repeat(rng.permutation(n // 10) * 9.0, 10), "long": np.sort(rng.uniform(size=n)) ** 3 * 2 * n,
    }[kind]
    df = frame(spark, v, 2)
    whole = local(soft_rank(df, "trial", "v", "pair_id", "s", n)).sort_values(["trial", "pair_id"])
    for size in (7, 50):
        conf(GROUP_ROWS_KEY, size)
        parts = local(soft_rank(df, "trial", "v", "pair_id", "s", n)).sort_values(["trial", "pair_id"])
        assert list(parts.columns) == list(whole.columns)
        np.testing.assert_allclose(parts.s.to_numpy(), whole.s.to_numpy(), rtol=1e-12, atol=1e-9)


def test_pooling_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        t = rng.integers(-5, 6, 12).astype(float)
        totals, sizes, starts = pooled(t.tolist(), [1] * 12)
        fit = np.repeat(np.array(totals) / np.array(sizes), sizes)
        # The largest of all least means over stretches that hold the place.
        want = [max(min(t[a : b + 1].mean() for a in range(k + 1)) for b in range(k, 12)) for k in range(12)]
        np.testing.assert_allclose(fit, want, atol=1e-12)
        assert starts == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()


def scored_stimuli(spark):
    rows = [(k, k % 5, float(k * k % 7), [float(k % 3), float(k % 4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, a long, b double, y array<double>")
    return Stimuli(df, ["a", "b"], "y", "id", dense=True)


@pytest.mark.parametrize("size", [1, 40, 300])
def test_large_importances_equal_the_windows(spark, conf, size):
    """Many ties, batches of one row included; only the counts of partition pairs stay written."""
    def found():
        out = importance_table(scored_stimuli(spark), (0.5, 0.25), size, 3, "manhattan", stream="s")
        return out.orderBy("feature", "permutation").collect()

    plain = found()
    conf(GROUP_ROWS_KEY, 0 if size == 1 else 25)
    mark = written(spark)
    large = found()
    assert release(spark, mark) == 1
    for a, b in zip(plain, large, strict=True):
        assert tuple(a[:3]) == tuple(b[:3]) and a["n"] == size
        np.testing.assert_allclose(a[3:], b[3:], atol=1e-12)


def test_large_importances_lose_pairs_as_the_windows_do(spark, conf):
    """A pair without its first row is not there; the others are permuted among themselves."""
    rows = [(None if k == 3 else k, float(k * k % 7), float(k % 4)) for k in range(30)]
    source = Stimuli(spark.createDataFrame(rows, "id long, a double, y double"), ["a"], "y", "id")
    conf(BROADCAST_BYTES_KEY, 10)
    found = lambda: importance_table(source, (0.5,), 200, 2, "manhattan", stream="s").orderBy("permutation").collect()
    plain = found()
    conf(GROUP_ROWS_KEY, 25)
    for a, b in zip(plain, found(), strict=True):
        assert a["n"] == b["n"] < 200
        np.testing.assert_allclose(a["baseline"], b["baseline"], atol=1e-12)


def test_one_task_and_the_driver_hold_little(spark):
    assert group_rows(spark) <= 1_000_000
    wide = spark.range(900_000).selectExpr(
        "id", *[f"double(id) as f{k}" for k in range(4)], "'AUTOMOBILE' as s", "array_repeat(double(id), 7) as y"
    )
    assert not fits_broadcast(wide, 900_000) and fits_broadcast(wide.limit(90_000), 90_000)


def test_a_fold_of_the_1_gb_size_is_not_sent_through_the_driver(spark):
    """Such a fold has 300,000 customers; three sides of each of three folds would pass through it."""
    fold = spark.range(300_000).selectExpr("id", "double(id) as f1", "'AUTOMOBILE' as f2", "array_repeat(double(id), 7) as y")
    assert broadcast_bytes(spark) <= 32 * 1024 * 1024
    assert not fits_broadcast(fold, 300_000) and fits_broadcast(fold.limit(30_000), 30_000)
