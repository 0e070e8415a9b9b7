import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica import Stimuli, align
from dyadica.functions.hashing import DRAWS_KEY, MD5, draw_numbers
from dyadica.operators.index import global_position
from dyadica.operators.pairs import meeting_mode, sample_pairs, sample_prefixes
from dyadica.session import BROADCAST_BYTES_KEY


def murmur(blocks, h):
    """Murmur3 of 32-bit blocks, from the state ``h``."""
    turned = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    for k in blocks:
        k = turned(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (turned(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 4 * len(blocks)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def drawn(stream, key):
    """Both 48-bit numbers of a pair."""
    digest = hashlib.md5(stream.encode()).digest()
    words = [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 12, 4)]
    a, b, c = (murmur([key & 0xFFFFFFFF, key >> 32], murmur([w], 42)) for w in words)
    return a << 16 | b & 0xFFFF, c << 16 | b >> 16


def small(spark, n=40, dense=True, target="y"):
    df = spark.range(n).select(
        F.col("id"),
        (F.col("id") % 7).cast("double").alias("v"),
        (F.col("id") % 3).cast("string").alias("s"),
        F.array(F.col("id").cast("double"), F.col("id") * 0.5).alias("y"),
    )
    return Stimuli(df, ["v", "s"], target, "id", dense=dense)


def test_sampler_matches_the_hashes(spark):
    source = small(spark)
    rows = sample_pairs(source, 10, 3, "s").collect()
    assert len(rows) == 30
    for r in rows:
        assert r["trial"] == r["pair_id"] // 10
        a, b = drawn("s", r["pair_id"])
        assert (r["i"], r["j"]) == (a % 40, b % 40)


def h48(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def test_sampler_matches_md5(spark, conf):
    conf(DRAWS_KEY, MD5)
    rows = sample_pairs(small(spark), 10, 3, "s").collect()
    assert len(rows) == 30
    for r in rows:
        assert r["trial"] == r["pair_id"] // 10
        assert r["i"] == h48(f"s:a:{r['pair_id']}") % 40
        assert r["j"] == h48(f"s:b:{r['pair_id']}") % 40


def test_hashes_of_large_numbers_and_their_spread(spark):
    ids = spark.sql("SELECT explode(array(0, 1, 4294967295, 4294967296, 4294967297, 1152921504606846975)) AS pair_id")
    for r in draw_numbers(ids, "t", "pair_id", "a", "b").collect():
        assert (r["a"], r["b"]) == drawn("t", r["pair_id"])
    n = 1 << 20
    df = spark.range(n).withColumnRenamed("id", "pair_id")
    both = draw_numbers(df, "u", "pair_id", "a", "b").selectExpr("a % 37 AS i", "b % 37 AS j", "pair_id % 37 AS k")
    for x, y in (("i", "j"), ("i", "k"), ("j", "k")):
        counts = np.array([r["count"] for r in both.groupBy(x, y).count().collect()])
        assert len(counts) == 37 * 37
        # A sum of squares of 1368 degrees of freedom.
        assert abs(((counts - n / 1369) ** 2).sum() / (n / 1369) - 1368) < 5 * (2 * 1368) ** 0.5


def test_draws_do_not_depend_on_partitioning(spark, conf):
    a = sample_pairs(small(spark), 50, 1, "s").collect()
    conf("spark.sql.leafNodeDefaultParallelism", 13)
    b = sample_pairs(small(spark), 50, 1, "s").collect()
    assert sorted(a) == sorted(b)


def test_both_orders_and_self_pairs(spark):
    rows = sample_pairs(small(spark, 3), 200, 1, "s").select("i", "j").distinct().collect()
    assert len(rows) == 9


def test_prefixes_are_nested(spark):
    source = small(spark)
    both = sample_prefixes(source, [4, 8], 2, 100, "s").collect()
    short = sample_prefixes(source, [4], 2, 100, "s").collect()
    assert {(r["pair_id"], r["i"], r["j"]) for r in short} == {
        (r["pair_id"], r["i"], r["j"]) for r in both if r["step"] == 0
    }


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("distance", ["euclidean", "norm_diff", None])
def test_gather_modes_agree(spark, dense, distance):
    source = small(spark, dense=dense)
    pairs = sample_pairs(source, 60, 1, "s")
    got = {}
    for mode in ("lookup", "ends", "semi", "shuffle"):
        out = source.distances(pairs, 60, distance, mode=mode)
        got[mode] = sorted(
            (r["pair_id"], r["i"], r["j"], tuple(r["x"]), r["d"] if distance else None) for r in out.collect()
        )
    assert len(got["lookup"]) == 60
    assert got["lookup"] == got["ends"] == got["semi"] == got["shuffle"]


def test_mode_follows_measured_size(spark, conf):
    source = small(spark, dense=True)
    pairs = sample_pairs(source, 60, 1, "s")
    plan = source.distances(pairs, 60)._jdf.queryExecution().toString()
    assert "side" not in plan
    conf(BROADCAST_BYTES_KEY, 10)
    source = small(spark, dense=True)
    plan = source.distances(sample_pairs(source, 60, 1, "s"), 60)._jdf.queryExecution().toString()
    assert "side" in plan and "ResolvedHint (strategy=broadcast)" not in plan


@pytest.mark.parametrize("dense", [True, False])
def test_modes_broadcast_only_what_fits(spark, conf, dense):
    """Ends and wanted ids beyond the limit meet the stimuli in shuffles, with the same result."""
    def found(mode):
        source = small(spark, dense=dense)
        out = source.distances(sample_pairs(source, 60, 1, "s"), 60, "euclidean", mode=mode)
        rows = sorted((r["pair_id"], r["i"], r["j"], tuple(r["x"]), r["d"]) for r in out.collect())
        return rows, out._jdf.queryExecution().toString()

    rows, _ = found("lookup")
    conf(BROADCAST_BYTES_KEY, 2 * 60 * 20)
    for mode in ("ends", "semi"):
        got, plan = found(mode)
        assert got == rows and "ResolvedHint (strategy=broadcast)" not in plan
        assert ("LeftSemi" in plan) == (mode == "semi")


def test_shuffled_pairs_carry_each_side_once(spark, conf):
    """Pairs travel once for each end, not as two rows that meet the stimuli by their ids."""
    conf(BROADCAST_BYTES_KEY, 10)
    source = small(spark)
    out = source.distances(sample_pairs(source, 60, 1, "s"), 60, None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "explode" not in plan and plan.count("SortMergeJoin") == 2


def test_rows_without_an_id_match_no_pair(spark):
    df = spark.createDataFrame([(None if k == 3 else k, float(k)) for k in range(8)], "id int, v double")
    source = Stimuli(df, ["v"], None, "id")
    pairs = sample_pairs(source, 60, 1, "s")
    rows = {}
    for mode in ("ends", "shuffle"):
        out = source.distances(pairs, 60, None, mode=mode).collect()
        rows[mode] = sorted((r["pair_id"], r["i"], -1 if r["j"] is None else r["j"], tuple(r["x"])) for r in out)
    assert rows["ends"] == rows["shuffle"] and 0 < len(rows["ends"]) < 60


def test_column_pruning_for_norms(spark, sf):
    """The vectors stay out of the shuffle when only their norm is needed."""
    source = small(spark)
    plan = (
        source.distances(sample_pairs(source, 60, 1, "s"), 60, "norm_diff", mode="ends")
        ._jdf.queryExecution().optimizedPlan().toString()
    )
    assert "a_y" not in plan


def test_positions(spark):
    df = spark.createDataFrame([(f"k{v:03d}",) for v in range(100)], "k string").repartition(7)
    placed, n = global_position(df, ["k"], "p", unique=True)
    assert n == 100
    assert {r["k"]: r["p"] for r in placed.collect()} == {f"k{v:03d}": v for v in range(100)}


def test_repeated_ids_are_refused(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id int, v double")
    with pytest.raises(ValueError):
        Stimuli(df, ["v"], None, "id").size()
    with pytest.raises(ValueError):
        Stimuli(df, ["v"], None, "id", dense=True).size()


def test_dense_ids_are_checked(spark):
    for ids in ([0, 1, 1, 3], [1, 2, 3], [0, 1, None]):
        df = spark.createDataFrame([(k, 1.0) for k in ids], "id bigint, v double")
        with pytest.raises(ValueError):
            Stimuli(df, ["v"], None, "id", dense=True).size()


def test_small_tables_are_shuffled_to_many_pairs(spark, conf):
    """Beyond the broadcast limit, the cheaper side of the choice depends on both sizes."""
    assert meeting_mode(spark, 100, 60) == "shuffle"
    assert meeting_mode(spark, 10**9, 60) == "ends"
    conf(BROADCAST_BYTES_KEY, 2 * 60 * 100)
    assert meeting_mode(spark, 10**9, 60) == "semi"
    assert meeting_mode(spark, 10**9, 60, key_bytes=100) == "shuffle"


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, v double")
    with pytest.raises(ValueError):
        sample_pairs(Stimuli(df, ["v"], None, "id"), 5)


def test_no_target(spark):
    source = small(spark, target=None)
    with pytest.raises(ValueError):
        source.distances(sample_pairs(source, 5), 5)
    assert source.distances(sample_pairs(source, 5), 5, None).columns[-1] == "x"


def test_align(spark):
    x = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    y = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, y double")
    assert align(x, y, "id").count() == 2
    with pytest.raises(ValueError):
        align(x, y.limit(1), "id")
    with pytest.raises(ValueError):
        align(x, y.withColumn("id", F.col("id") + 1), "id")


def test_uniformity(spark):
    source = small(spark, 10)
    counts = np.array(
        [r["c"] for r in sample_pairs(source, 20000, 1, "u").groupBy("i").agg(F.count("*").alias("c")).collect()]
    )
    assert len(counts) == 10 and abs(counts - 2000).max() < 250
