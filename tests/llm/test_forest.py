import numpy as np
import pytest

from dyadica.llm import forest as T
from dyadica.llm.queries import op10_forest


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        row = x[ids == q][0]
        score = np.sum(x * row, axis=1)
        score[ids == q] = -np.inf
        order = [i for i in np.lexsort((ids, -score)) if score[i] > -np.inf][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in out.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [r[1:] for r in rows] for q, rows in out.items()}


def recall(got, want):
    return sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, vec array<double>")


def test_query_reaches_the_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got, want = found(op10_forest(spark, sf)), brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q in got:
        true = {v: s for v, s in brute(ids, x, [q], len(ids))[q]}
        assert all(s == pytest.approx(true[v], abs=1e-12) for v, s in got[q])


def test_many_leaves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAF_ROWS", 40)
    monkeypatch.setattr(T, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 4000)] + 0.2 * rng.normal(size=(4000, 12))
    df = table(spark, x)
    fitted = T.fit(df, 10)
    assert all(t.n_leaves > 20 for t in fitted.trees) and fitted.share < 1
    got = found(T.nearest(df, df.filter("id % 20 = 0"), 10, fitted))
    assert recall(got, brute(np.arange(4000), x, range(0, 4000, 20), 10)) >= 0.9


def test_a_third_of_equal_vectors_and_other_norms(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAF_ROWS", 60)
    monkeypatch.setattr(T, "GROUP_VALUES", 1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1800, 6)) * rng.uniform(0.2, 3.0, size=(1800, 1))
    x[::3] = x[0]
    df = table(spark, x)
    got = found(T.nearest(df, df.filter("id % 20 = 0"), 8))
    want = brute(np.arange(1800), x, range(0, 1800, 20), 8)
    assert recall(got, want) >= 0.9
    assert [v for v, _ in got[60]] == [v for v, _ in want[60]]


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    raw = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, []), (8, [1.0, 2.0, 3.0]), (9, [0.0, 1.0]), (None, [1.0, 1.0]), (40, None), (11, [1.0, 0.0]), (12, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as score", "3 as leaf")
    v = T.valid(df, "vec_id", "embedding")
    got = found(T.nearest(v, v.filter("id % 20 = 0"), 20))
    assert got[0] == [(11, 1.0), (12, 1.0), (20, 0.5), (9, 0.0)]
    assert got[20] == [(0, 0.5), (9, 0.5), (11, 0.5), (12, 0.5)] and set(got) == {0, 20}
    none = v.filter("false")
    assert T.nearest(none, none, 20).count() == 0
    assert T.nearest(v, none, 20).count() == 0
