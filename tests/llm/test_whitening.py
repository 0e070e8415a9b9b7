import math
from fractions import Fraction

import numpy as np
import pytest

from dyadica.llm import whitening as W
from dyadica.llm.queries import op11_whitening
from dyadica.llm.spectrum import Factor, leading

SCHEMA = "vec_id long, embedding array<double>, component string, n string, _id string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n", "i", 1) for i, v in rows], SCHEMA)


def brute(rows, wanted=4):
    """Everything by exact fractions, then the eigenvalues of the library."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * Fraction(c)) for c in v)) for i, v in usable]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    cov = np.array([[float(sum((x[a] - Fraction(s[a], n)) * (x[b] - Fraction(s[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    out = {}
    for i, x in xs:
        centred = np.array([float(x[k] - Fraction(s[k], n)) for k in range(d)])
        deviation = sum((n * x[k] - s[k]) ** 2 for k in range(d))
        out[i] = [(n, deviation, centred @ u[:, k] / math.sqrt(e[k]), e[k] / np.trace(cov)) for k in range(len(e))]
    return out


def agree(got, want):
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id][r.component - 1]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(whitened, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-10)
        assert 0 <= r.identity_error < 1e-10


def test_query_agrees_with_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()][:300]
    small = frame(spark, rows).select("vec_id", "embedding")
    agree(W.whiten(small, "vec_id", "embedding").collect(), brute(rows))
    whole = op11_whitening(spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert whole.count() == 4 * n and whole.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_left_out_rows_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).round(2).tolist()) for k in range(40)]
    rows += [(50 + k, rows[k][1]) for k in range(30)] + [(100 + k, rows[0][1]) for k in range(200)]
    # Entries that floor to the same whole number are one vector of the list.
    rows += [(400, [c + 1e-7 if math.floor(256 * (c + 1e-7)) == math.floor(256 * c) else c for c in rows[1][1]])]
    odd = [None, [], [1.0] * 5, [1.0] * 7, [None] + [1.0] * 5, [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5, [1e300] + [0.0] * 5]
    df = frame(spark, rows + [(1000 + k, v) for k, v in enumerate(odd)]).repartition(5)
    agree(W.whiten(df, "vec_id", "embedding").collect(), brute(rows))
    nothing = frame(spark, [])
    assert W.whiten(nothing, "vec_id", "embedding").count() == 0
    assert W.whiten(frame(spark, [(1, None), (2, [])]), "vec_id", "embedding").count() == 0
    # One vector has no variance.
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").count() == 0
    got = W.whiten(frame(spark, [(None, [1.0, 0.0]), (None, [2.0, 0.0])]), "vec_id", "embedding").collect()
    assert [(r.vec_id, r.component, abs(r.whitened), r.explained) for r in got] == [(None, 1, 1.0, 1.0)] * 2


@pytest.mark.parametrize("scale", [1e-1, 1e3, 1e6, 1e9, 1e13])
def test_large_entries_far_from_zero(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(k, ((rng.normal(size=3) * [1, 2, 3] + 1000) * scale).tolist()) for k in range(30)]
    want = brute(rows)
    got = W.whiten(frame(spark, rows), "vec_id", "embedding").collect()
    assert len(got) == 90
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id][r.component - 1]
        assert r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None)
        assert r.whitened == pytest.approx(whitened, rel=1e-9, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-12)


def test_partitions_change_no_digit(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = (W.fit(df.repartition(k), "embedding") for k in (1, 7))
    assert (a.sums == b.sums).all() and (a.components == b.components).all() and (a.variances == b.variances).all()


def test_packing_keeps_equal_rows_equal():
    x = np.array([[0, 1], [32767, -32768], [32768, 0], [-32769, 0], [1 << 40, -5], [0, 1]])
    p = W.packed(x)
    assert [len(v) for v in p] == [4, 4, 8, 8, 16, 4] and p[0] == p[5]
    import pyarrow as pa

    assert (W.unpacked(pa.array(p), 2) == x).all()


def spectra():
    rng = np.random.default_rng(5)
    yield from ([5, 5, 5, 5, 1], [3, 3 * (1 - 1e-9), 3 * (1 - 1e-12), 1, 0], [1] * 6, [2, 1, 0, 0], [1e200, 1e199, 1e198], [0, 0, 0])
    for _ in range(150):
        n = int(rng.integers(1, 12))
        d = np.ones(n)
        for k in range(n):
            d[k] = 1 - 10.0 ** rng.uniform(-17, 0) if rng.random() < 0.7 else 10.0 ** rng.uniform(-17, 0)
        yield d


def test_slicing_finds_leading_eigenvalues():
    rng = np.random.default_rng(6)
    for d in spectra():
        n = len(d)
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        a = (q * np.array(d, dtype=float)) @ q.T
        a = (a + a.T) / 2
        e, u = leading(a, 4)
        want, scale = np.linalg.eigvalsh(a)[::-1], np.abs(a).max() or 1.0
        assert len(e) == min(4, n) or want[len(e)] <= 1e-13 * scale
        assert np.abs(e - want[: len(e)]).max(initial=0) <= 1e-10 * scale and (np.diff(e) <= 0).all()
        assert np.abs(u.T @ u - np.eye(len(e))).max(initial=0) < 1e-12
        assert np.abs(a @ u - u * e).max(initial=0) <= 1e-9 * scale


def test_inertia_and_solutions():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*rng.normal(size=10) * 3, *((values[1:] + values[:-1]) / 2)]:
            assert Factor(a - shift * np.eye(n)).positive == (values > shift).sum()
        b = rng.normal(size=n)
        assert a @ Factor(a).solve(b) == pytest.approx(b, abs=1e-8)
    zero_diagonal = np.array([[0.0, 1, 2], [1, 0, 3], [2, 3, 0]])
    assert Factor(zero_diagonal).positive == (np.linalg.eigvalsh(zero_diagonal) > 0).sum()
