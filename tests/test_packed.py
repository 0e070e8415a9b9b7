import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadica.operators import packed as K, pairs as P
from dyadica.operators.packed import gather_packed, packable
from dyadica.plans import importance
from dyadica.plans.importance import importance_table
from dyadica.session import BROADCAST_BYTES_KEY, GROUP_ROWS_KEY, release, written
from dyadica.sources.stimuli import Stimuli


def odd_table(n, seed):
    """Few and many values, nulls, NaN, -0, the ends of long numbers, lists alike and not."""
    rng = np.random.default_rng(seed)
    pick = lambda values: [values[k] for k in rng.integers(0, len(values), n)]
    return pa.table({
        "key": pa.array(rng.integers(0, 50, n)),
        "wide": pa.array(pick([2**63 - 1, -(2**63), 0, 5])),
        "gap": pa.array(pick([None, 3, -7]), pa.int64()),
        "few": pa.array(pick([0.1, -0.0, float("nan"), None]), pa.float64()),
        "many": pa.array(rng.normal(size=n)),
        "text": pa.array(pick(["a", "", None, "ü"])),
        "alike": pa.array(pick([[1.0, 2.0], [0.5, None]]), pa.list_(pa.float64())),
        "lists": pa.array(pick([[1.0], [], None, [2.0, 3.0]]), pa.list_(pa.float64())),
        "flag": pa.array(pick([True, False, None])),
    })


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_packed_rows_come_back(n):
    table = odd_table(n, n)
    order = np.argsort(table.column("key").to_numpy(), kind="stable")
    cuts = sorted({0, n // 3, n // 2, n})
    got = [K.load(rows, table.schema) for rows in K.dump(table, "key", order, cuts)]
    want = table.take(pa.array(order))
    assert repr(pa.Table.from_batches(got).to_pydict()) == repr(want.to_pydict())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pairs_meet_packed_values_as_in_a_shuffle(spark, monkeypatch, parts):
    """Positions without a row included: at the first end the pair is lost, at the second its values."""
    monkeypatch.setattr(K, "OUT_ROWS", 50)
    n = 40
    pairs = spark.range(900).select(
        F.col("id").alias("pair_id"), F.expr("id div 300").alias("trial"),
        F.expr("pmod(hash(id), 40L)").cast("bigint").alias("i"), F.expr("pmod(hash(id, 1), 40L)").cast("bigint").alias("j"),
    )
    values = spark.range(n).filter("id not in (0, 11, 39)").select(
        F.col("id").alias("sid"), F.expr("if(id % 7 = 0, null, double(id) / 3)").alias("f0"),
        F.expr("string(id % 3)").alias("f1"), F.expr("array(double(id), 0.5D)").alias("y0"),
    )
    assert packable(values.schema) and packable(pairs.schema)
    plain = P.gather_by_shuffle(pairs, values)
    got = gather_packed(pairs, values, n, parts)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in plain.schema]
    rows = [sorted(map(str, df.collect())) for df in (plain, got)]
    assert rows[0] == rows[1] and 0 < len(rows[0]) < 900


def test_a_packed_shuffle_takes_less(spark):
    """Rows like those of lines: 8 bytes of them are a column of many values, 4 the pair."""
    rng = np.random.default_rng(1)
    n = 200_000
    table = pa.table({
        "pair_id": pa.array(np.arange(n)), "j": pa.array(rng.integers(0, n, n)), "a_f0": pa.array(rng.uniform(size=n)),
        "a_f1": pa.array(rng.integers(0, 50, n) / 50.0), "a_f2": pa.array(rng.choice(["A", "N", "R"], n)),
        "a_y0": pa.FixedSizeListArray.from_arrays(pa.array(rng.integers(0, 9, 2 * n) / 9.0), 2).cast(pa.list_(pa.float64())),
    })
    order = np.argsort(table.column("j").to_numpy(), kind="stable")
    assert sum(map(len, K.dump(table, "j", order, list(range(0, n + 1, 2000))))) < 18 * n


def spread_stimuli(spark, n=200):
    rows = [(k * 3, f"{k % 5}", float(k * k % 17), [float(k % 3), float(k % 4)]) for k in range(n)]
    return Stimuli(spark.createDataFrame(rows, "id long, a string, b double, y array<double>"), ["a", "b"], "y", "id")


def test_large_importances_are_taken_in_rounds(spark, conf, monkeypatch):
    """A round's pairs are written and gone again before the next; the results are those of all at once."""
    found = lambda: importance_table(spread_stimuli(spark), (0.5, 0.25), 300, 3, "manhattan", stream="s")
    plain = found().orderBy("feature", "permutation").collect()
    conf(BROADCAST_BYTES_KEY, 10)
    conf(GROUP_ROWS_KEY, 100)
    monkeypatch.setattr(importance, "ROUND_PAIRS", 700)
    sizes, real = [], importance.materialize
    monkeypatch.setattr(importance, "materialize", lambda df, **k: (out := real(df, **k), sizes.append(out.count()))[0])
    mark = written(spark)
    large = found().orderBy("feature", "permutation").collect()
    assert sizes == [600, 600] * 3
    release(spark, mark)
    for a, b in zip(plain, large, strict=True):
        assert tuple(a[:3]) == tuple(b[:3]) and a["n"] == 300
        np.testing.assert_allclose(a[3:], b[3:], atol=1e-12)


def test_large_importances_meet_their_stimuli_packed(spark, conf):
    """Both shuffles of pairs and stimuli deal packed rows."""
    conf(BROADCAST_BYTES_KEY, 10)
    source = spread_stimuli(spark)
    pairs = P.sample_pairs(source, 5000, 1, "s")
    plan = source.distances(pairs, 5000, "manhattan", mode="packed")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("MapInArrow") >= 3
    plain = source.distances(pairs, 5000, "manhattan").orderBy("pair_id").collect()
    assert source.distances(pairs, 5000, "manhattan", mode="packed").orderBy("pair_id").collect() == plain
