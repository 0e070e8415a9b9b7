"""The registered queries. Each reads its tables whole, and draws pairs in proportion to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import fixtures as X
from catalog.fixtures import r6, table
from dyadica import MetricEncoder, PrecomputedPairs, Stimuli
from dyadica.functions.distances import term_names
from dyadica.operators.correlation import (
    pearson, pearson_eps, prefix_correlations, spearman, stability,
)
from dyadica.operators.encode import classify, encode_codes, encode_table, scaled, scaling_bounds
from dyadica.operators.exact import exact_moments
from dyadica.operators.moments import moment_vectors
from dyadica.operators.pairs import sample_pairs
from dyadica.operators.ranks import shuffle_within, soft_rank, soft_rank_affine
from dyadica.operators.scaling import minmax_square_distances
from dyadica.operators.splits import train_test_split, with_fold
from dyadica.plans.batch_size import candidate_sizes, estimate_batch_size, size_stability
from dyadica.plans.fit import fit_pooled
from dyadica.plans.importance import importance_table, predict, scores_table, wide_importances
from dyadica.plans.encoder import square_weights, weights_table
from dyadica.plans.recipes import cross_validate, fit_many, holdout

STREAM = str(X.SEED)
# Literal weights of the scoring queries.
WEIGHTS_3 = (0.8847, 0.4423, 0.1474)
WEIGHTS_5 = (0.7, 0.5, 0.4, 0.3, 0.1)
WEIGHTS_TERMS = (0.6, 0.3, 0.5, 0.2, 0.1, 0.4)


# The ways in which pairs meet a table too large for a broadcast.
MODES = ("ends", "semi", "shuffle")

# ------------------------------------------------------------------ encoding


def encode_minmax(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    bounds = scaling_bounds(df, classify(df.schema, names))
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[r6(scaled(c, bounds)).alias(c) for c in names]
    )


def encode_codes_query(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return encode_codes(df, ["p_brand", "p_type", "p_size"]).select(
        "p_partkey", "p_brand", "p_type", "p_size"
    )


def encode_missing(spark: SparkSession, sf: str) -> DataFrame:
    out = encode_table(
        X.labelled_documents(spark, sf), ["n_chars", "lang", "quality", "toxic"], ["toxic"]
    )
    return out.select(
        "doc_id", r6(F.col("n_chars")).alias("n_chars"), "lang",
        r6(F.col("quality")).alias("quality"), "toxic",
    )


def encode_types(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("filled"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").alias("at"),
    )
    out = encode_table(df, ["filled", "day", "price", "at"])
    return out.select("o_orderkey", "filled", "day", r6(F.col("price")).alias("price"), "at")


# --------------------------------------------------------------------- pairs


def sample_pairs_query(spark: SparkSession, sf: str) -> DataFrame:
    source = X.customers(spark, sf)
    return sample_pairs(source, 2 * source.size(), 1, STREAM).select("pair_id", "i", "j")


def sample_trials(spark: SparkSession, sf: str) -> DataFrame:
    source = Stimuli(
        table(spark, sf, "orders"), ["o_totalprice"], None, "o_orderkey", dense=True
    )
    return sample_pairs(source, source.size(), 4, STREAM).select("pair_id", "trial", "i", "j")


def _terms(df: DataFrame, names) -> list:
    return [r6(F.get("x", F.lit(k))).alias(n) for k, n in enumerate(names)]


def feature_dist(spark: SparkSession, sf: str) -> DataFrame:
    source = X.lines(spark, sf)
    n = source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, None)
    return out.select("pair_id", "i", "j", *_terms(out, source.feature_names))


def _feature_dist_by(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    """The same pairs, met in the way that larger tables would be."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        source = X.lines(spark, sf)
        n = source.size()
        out = source.distances(sample_pairs(source, n, 1, STREAM), n, None, mode=mode)
        return out.select("pair_id", "i", "j", *_terms(out, source.feature_names))

    return run


def _euclidean_by(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        source = X.vectors(spark, sf)
        n = 4 * source.size()
        out = source.distances(sample_pairs(source, n, 1, STREAM), n, "euclidean", mode=mode)
        return out.select("pair_id", r6(F.col("d")).alias("d"))

    return run


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    source = X.customers(spark, sf)
    n = 2 * source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, None, interactions=True)
    return out.select("pair_id", *_terms(out, term_names(source.feature_names, True)))


def missing_fill(spark: SparkSession, sf: str) -> DataFrame:
    source = Stimuli(
        X.labelled_documents(spark, sf), ["quality", "toxic", "n_chars"], None, "doc_id",
        categorical=["toxic"],
    )
    n = 2 * source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, None, nan_to_num=1.0)
    return out.select("pair_id", *_terms(out, source.feature_names))


def raw_features(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select(
        "p_partkey", F.array(F.col("p_size") / 40, F.col("p_retailprice") / 1000).alias("x")
    )
    source = Stimuli(df, "x", None, "p_partkey", dense=True)
    n = 2 * source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, None)
    return out.select("pair_id", *_terms(out, source.feature_names))


# ----------------------------------------------------- representation distances


def _distance(source: Stimuli, distance, per_row: int = 2) -> DataFrame:
    n = per_row * source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, distance)
    return out.select("pair_id", r6(F.col("d")).alias("d"))


def euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return _distance(X.vectors(spark, sf), "euclidean", 4)


def manhattan(spark: SparkSession, sf: str) -> DataFrame:
    return _distance(X.vectors(spark, sf), "manhattan", 4)


def cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _distance(X.vectors(spark, sf), "cosine", 4)


def norm_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _distance(X.parts(spark, sf), "norm_diff")


def custom_distance(spark: SparkSession, sf: str) -> DataFrame:
    def largest_gap(a, b):
        return F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v)))

    return _distance(X.vectors(spark, sf), largest_gap, 4)


def scalar_target(spark: SparkSession, sf: str) -> DataFrame:
    return _distance(X.customers(spark, sf), "euclidean")


def nested_target(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select(
        "p_partkey", "p_type",
        F.array(
            F.array(F.col("p_size").cast("double"), F.col("p_retailprice")),
            F.array(F.col("p_retailprice") / 10),
        ).alias("y"),
    )
    return _distance(Stimuli(df, ["p_type"], "y", "p_partkey", dense=True), "manhattan")


def precomputed(spark: SparkSession, sf: str) -> DataFrame:
    source = X.listed_pairs(spark, sf)
    n = source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, interactions=True)
    names = term_names(source.feature_names, True)
    return out.select("pair_id", "i", "j", *_terms(out, names), r6(F.col("d")).alias("d"))


def minmax_square(spark: SparkSession, sf: str) -> DataFrame:
    source = X.vectors(spark, sf)
    n = 4 * source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, "euclidean")
    return minmax_square_distances(out).select("pair_id", r6(F.col("s")).alias("s"))


def running_minmax(spark: SparkSession, sf: str) -> DataFrame:
    source = X.parts(spark, sf)
    n, steps = source.size(), 8
    out = source.distances(sample_pairs(source, n, steps, STREAM), n * steps, "euclidean")
    return minmax_square_distances(out).select("pair_id", "trial", r6(F.col("s")).alias("s"))


# --------------------------------------------------------------- correlations


def _trials(source, n_trials: int, distance="euclidean") -> DataFrame:
    n = source.size()
    return source.distances(sample_pairs(source, n, n_trials, STREAM), n * n_trials, distance)


def pearson_eps_query(spark: SparkSession, sf: str) -> DataFrame:
    out = _trials(X.planted(spark, sf), 4)
    x = [F.get("x", F.lit(k)) for k in range(2)]
    return out.groupBy("trial").agg(
        r6(pearson_eps(x[0], F.col("d"))).alias("balance"),
        r6(pearson_eps(x[1], F.col("d"))).alias("segment"),
        r6(pearson_eps(x[0] * F.lit(0.0), F.col("d"))).alias("constant"),
    )


def pearson_plain(spark: SparkSession, sf: str) -> DataFrame:
    out = _trials(X.described_vectors(spark, sf), 4)
    return out.groupBy("trial").agg(
        *[
            r6(pearson(F.get("x", F.lit(k)), F.col("d"))).alias(c)
            for k, c in enumerate(["lang", "source", "n_chars"])
        ]
    )


def _feature_correlations(spark: SparkSession, sf: str) -> DataFrame:
    source = X.lines(spark, sf)
    out = _trials(source, 4, None).withColumn("step", F.lit(0))
    moments = moment_vectors(out, source.n_features, by=("trial", "step"))
    return prefix_correlations(moments, source.n_features)


def feature_corr(spark: SparkSession, sf: str) -> DataFrame:
    return _feature_correlations(spark, sf).select(
        "trial", "a", "b", r6(F.col("corr")).alias("corr")
    )


def corr_std(spark: SparkSession, sf: str) -> DataFrame:
    return stability(_feature_correlations(spark, sf)).select(
        r6(F.col("max_std")).alias("max_std"), r6(F.col("max_corr")).alias("max_corr")
    )


def _spearman(spark: SparkSession, sf: str, n_trials: int, ties: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = _trials(source, n_trials).withColumn("p", predict(WEIGHTS_3))
    got = spearman(out, "trial", "p", "d", "pair_id", source.size(), ties)
    return got.select("trial", r6(F.col("spearman")).alias("spearman"))


def spearman_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    source = X.described_vectors(spark, sf)
    n = 8 * source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, "cosine")
    out = out.withColumn("p", predict(WEIGHTS_3))
    got = spearman(out, "trial", "p", "d", "pair_id", n)
    return got.select("trial", r6(F.col("spearman")).alias("spearman"))


def spearman_average(spark: SparkSession, sf: str) -> DataFrame:
    return _spearman(spark, sf, 4, "average")


def spearman_batched(spark: SparkSession, sf: str) -> DataFrame:
    return _spearman(spark, sf, 8, "ordinal")


def soft_rank_query(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = _trials(source, 4).withColumn("p", predict(WEIGHTS_3))
    got = soft_rank_affine(out.select("trial", "pair_id", "p"), "trial", "p", "soft")
    return got.select("trial", "pair_id", r6(F.col("soft")).alias("soft"))


def soft_rank_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Values that span far more than half a batch: ranks where they lie apart, values where close."""
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    n = source.size()
    out = _trials(source, 2).withColumn("p", predict(WEIGHTS_3) * F.lit(float(n)))
    got = soft_rank(out.select("trial", "pair_id", "p"), "trial", "p", "pair_id", "soft", n)
    return got.select("trial", "pair_id", r6(F.col("soft")).alias("soft"))


def spearman_soft(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = minmax_square_distances(_trials(source, 4)).withColumn("p", predict(WEIGHTS_3))
    ranked = soft_rank_affine(out.select("trial", "pair_id", "p", "s"), "trial", "p", "rp")
    ranked = soft_rank_affine(ranked, "trial", "s", "rs")
    return ranked.groupBy("trial").agg(r6(pearson(F.col("rp"), F.col("rs"))).alias("spearman"))


def exact_feature_cov(spark: SparkSession, sf: str) -> DataFrame:
    """Over all n * n pairs of the labelled documents, missing labels included, without a pair."""
    source = Stimuli(
        X.labelled_documents(spark, sf), ["n_chars", "lang", "quality", "toxic"], None, "doc_id",
        categorical=["lang", "toxic"],
    )
    found = exact_moments(source, nan_to_num=0.5)
    names, corr = found.names, found.correlation()
    rows = [
        (names[a], names[b], float(found.mean[a]), float(found.cov[a, b]), float(corr[a, b]))
        for a in range(len(names)) for b in range(a + 1)
    ]
    out = spark.createDataFrame(rows, "a string, b string, mean double, cov double, corr double")
    return out.select("a", "b", *[r6(F.col(c)).alias(c) for c in ("mean", "cov", "corr")])


# ----------------------------------------------------------------- batch size


def batch_size(spark: SparkSession, sf: str) -> DataFrame:
    source = X.lines(spark, sf)
    largest = source.size()
    sizes, _ = candidate_sizes(256, largest, 2.0)
    rows = size_stability(source, sizes, 4, largest, STREAM)
    return rows.select(
        "batch_size", r6(F.col("max_std")).alias("max_std"), r6(F.col("max_corr")).alias("max_corr")
    )


# Fixed value: how little the correlations of a chosen size may vary.
CHOSEN_THRESHOLD = 0.02


def chosen_batch_size(spark: SparkSession, sf: str) -> DataFrame:
    """The size an estimate returns, with its early stop."""
    source = X.lines(spark, sf)
    size = estimate_batch_size(source, 256, 4, CHOSEN_THRESHOLD, 2.0, source.size(), stream=STREAM)
    return spark.createDataFrame([(size,)], "batch_size bigint")


# ------------------------------------------------------------------------ fit


# Steps of the stepwise fits, and the settings of the one with decay.
STEPS = 200
DECAYED = {"lr": 0.05, "weight_decay": 0.2, "patience": 20}


def _encoder(source, **kw) -> MetricEncoder:
    n = source.size()
    return MetricEncoder(
        batch_size=n, max_steps=kw.pop("max_steps", 8), random_seed=X.SEED,
        max_fit_pairs=8 * n, tolerance=0.0, **kw,
    )


def _weights(encoder: MetricEncoder, source) -> DataFrame:
    out = encoder.fit(source).get_weights()
    return out.withColumn("weight", r6(F.col("weight")))


def fit_two_features(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2"))
    return _weights(_encoder(source), source)


def fit_weights(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    return _weights(_encoder(source), source)


def fit_interactions(spark: SparkSession, sf: str) -> DataFrame:
    source = X.listed_pairs(spark, sf)
    return _weights(_encoder(source, interactions=True, distance="precomputed"), source)


def square_weights_query(spark: SparkSession, sf: str) -> DataFrame:
    return square_weights(fit_interactions(spark, sf), ["gap", "mismatch"])


def fit_precomputed(spark: SparkSession, sf: str) -> DataFrame:
    source = X.listed_pairs(spark, sf)
    return _weights(_encoder(source, distance="precomputed"), source)


def fit_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Distances far from 0: the spread must not drown in the mean."""
    source = X.listed_pairs(spark, sf, X.OFFSET)
    return _weights(_encoder(source, distance="precomputed"), source)


def fit_zero_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Distances that fall with the last feature: its weight stays at its bound."""
    source = X.bounded_pairs(spark, sf)
    return _weights(_encoder(source, distance="precomputed"), source)


def fit_edge(spark: SparkSession, sf: str) -> DataFrame:
    """An interaction stronger than any semidefinite matrix allows: the best one is singular."""
    source = X.listed_pairs(spark, sf, weights=X.OUTSIDE)
    return _weights(_encoder(source, interactions=True, distance="precomputed"), source)


def fit_many_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two representations of the same customers from one reading of the pairs."""
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = None
    for name, fitted in fit_many(_encoder(source), source, {"planted": "y", "second": "z"}).items():
        got = fitted.get_weights().select(F.lit(name).alias("target"), "feature", r6(F.col("weight")).alias("weight"))
        out = got if out is None else out.unionByName(got)
    return out


def fit_steps_query(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf)
    return _weights(_encoder(source, solver="steps", max_steps=STEPS), source)


def fit_steps_decay(spark: SparkSession, sf: str) -> DataFrame:
    """The same with weight decay, another rate and a short patience."""
    source = X.planted(spark, sf)
    return _weights(_encoder(source, solver="steps", max_steps=STEPS, **DECAYED), source)


def predict_query(spark: SparkSession, sf: str) -> DataFrame:
    source = X.lines(spark, sf)
    n = source.size()
    out = source.distances(sample_pairs(source, n, 1, STREAM), n, None)
    return out.select("pair_id", r6(predict(WEIGHTS_5)).alias("prediction"))


# ---------------------------------------------------------------------- score


def permutation(spark: SparkSession, sf: str) -> DataFrame:
    source = X.customers(spark, sf)
    n = source.size()
    out = source.distances(sample_pairs(source, n, 4, STREAM), 4 * n, None)
    flat = out.select("trial", "pair_id", F.get("x", F.lit(0)).alias("v"))
    got = shuffle_within(flat, "trial", "v", STREAM, "moved", n)
    return got.select("trial", "pair_id", r6(F.col("v")).alias("v"), r6(F.col("moved")).alias("moved"))


def _rounded(importances: DataFrame, *more: str) -> DataFrame:
    values = [r6(F.col(c)).alias(c) for c in ("baseline", "permuted", "importance")]
    return importances.select(*more, "feature", "permutation", *values)


def pfi_literal_weights(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = importance_table(source, WEIGHTS_3, 2 * source.size(), 2, "euclidean", stream=STREAM)
    return _rounded(out)


def pfi_lines(spark: SparkSession, sf: str) -> DataFrame:
    source = X.lines(spark, sf)
    out = importance_table(source, WEIGHTS_5, source.size(), 1, "manhattan", stream=STREAM)
    return _rounded(out)


def pfi_interactions(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = importance_table(
        source, WEIGHTS_TERMS, source.size(), 2, "euclidean", interactions=True, stream=STREAM
    )
    return _rounded(out)


def pfi_precomputed(spark: SparkSession, sf: str) -> DataFrame:
    source = X.listed_pairs(spark, sf)
    out = importance_table(source, (0.9, 0.4), source.size(), 2, "precomputed", stream=STREAM)
    return _rounded(out)


def pfi_holdout(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    _, test = train_test_split(source.df, "c_custkey", 75, X.SEED)
    held = source.replace(test)
    out = importance_table(held, WEIGHTS_3, 2 * held.size(), 2, "euclidean", stream=STREAM)
    return _rounded(out)


def pfi_kfold(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    folded = with_fold(source.df, 3, "c_custkey", X.SEED)
    out = None
    for f in range(3):
        held = source.replace(folded.filter(F.col("fold") == f).drop("fold"))
        got = importance_table(held, WEIGHTS_3, 2 * held.size(), 1, "euclidean", stream=STREAM)
        got = got.withColumn("split", F.lit(f))
        out = got if out is None else out.unionByName(got)
    return _rounded(out, "split")


def importances_wide(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = importance_table(source, WEIGHTS_3, 2 * source.size(), 2, "euclidean", stream=STREAM)
    wide = wide_importances(out, source.feature_names)
    return wide.select("permutation", *[r6(F.col(c)).alias(c) for c in source.feature_names])


def score_spread(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf, ("f1", "f2", "f3"))
    out = importance_table(source, WEIGHTS_3, source.size(), 3, "norm_diff", stream=STREAM)
    return scores_table(out).agg(
        F.count("spearman").alias("n"), r6(F.stddev_samp("spearman")).alias("sd")
    )


def train_test(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey")
    train, test = train_test_split(df, "o_orderkey", 75, X.SEED)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return with_fold(table(spark, sf, "orders").select("o_orderkey"), 5, "o_orderkey", X.SEED)


def fit_and_score(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf)
    importances, _ = _encoder(source).fit(source).score()
    return _rounded(importances)


def fit_and_score_holdout(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf)
    importances, _ = holdout(_encoder(source, n_permutations=2), source, 75, X.SEED)
    return _rounded(importances)


def fit_and_score_kfold(spark: SparkSession, sf: str) -> DataFrame:
    source = X.planted(spark, sf)
    importances, _ = cross_validate(_encoder(source, n_permutations=1), source, 3, X.SEED, one_pass=False)
    return _rounded(importances, "split")


def fit_and_score_folds(spark: SparkSession, sf: str) -> DataFrame:
    """The same with pairs drawn over all rows and read once for all folds."""
    source = X.planted(spark, sf)
    importances, _ = cross_validate(_encoder(source, n_permutations=1), source, 3, X.SEED)
    return _rounded(importances, "split")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "encode_minmax": encode_minmax,
    "encode_codes": encode_codes_query,
    "encode_missing": encode_missing,
    "encode_types": encode_types,
    "sample_pairs": sample_pairs_query,
    "sample_trials": sample_trials,
    "feature_dist": feature_dist,
    **{f"feature_dist_{m}": _feature_dist_by(m) for m in MODES},
    **{f"euclidean_{m}": _euclidean_by(m) for m in MODES},
    "interactions": interactions,
    "missing_fill": missing_fill,
    "raw_features": raw_features,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "cosine": cosine,
    "norm_diff": norm_diff,
    "custom_distance": custom_distance,
    "scalar_target": scalar_target,
    "nested_target": nested_target,
    "precomputed": precomputed,
    "minmax_square": minmax_square,
    "running_minmax": running_minmax,
    "pearson_eps": pearson_eps_query,
    "pearson_plain": pearson_plain,
    "feature_corr": feature_corr,
    "corr_std": corr_std,
    "exact_feature_cov": exact_feature_cov,
    "spearman_ordinal": spearman_ordinal,
    "spearman_average": spearman_average,
    "spearman_batched": spearman_batched,
    "soft_rank_affine": soft_rank_query,
    "soft_rank_wide": soft_rank_wide,
    "spearman_soft": spearman_soft,
    "batch_size": batch_size,
    "chosen_batch_size": chosen_batch_size,
    "fit_two_features": fit_two_features,
    "fit_weights": fit_weights,
    "fit_interactions": fit_interactions,
    "square_weights": square_weights_query,
    "fit_precomputed": fit_precomputed,
    "fit_offset": fit_offset,
    "fit_steps": fit_steps_query,
    "fit_steps_decay": fit_steps_decay,
    "predict": predict_query,
    "permutation": permutation,
    "pfi_literal_weights": pfi_literal_weights,
    "pfi_lines": pfi_lines,
    "pfi_interactions": pfi_interactions,
    "pfi_precomputed": pfi_precomputed,
    "pfi_holdout": pfi_holdout,
    "pfi_kfold": pfi_kfold,
    "importances_wide": importances_wide,
    "score_spread": score_spread,
    "train_test": train_test,
    "folds": folds,
    "fit_and_score": fit_and_score,
    "fit_and_score_holdout": fit_and_score_holdout,
    "fit_and_score_kfold": fit_and_score_kfold,
    "fit_and_score_folds": fit_and_score_folds,
    "fit_many": fit_many_query,
    "fit_zero_weight": fit_zero_weight,
    "fit_edge": fit_edge,
}
