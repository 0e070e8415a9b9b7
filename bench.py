"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
warnings.simplefilter("ignore")

from catalog import fixtures as X  # noqa: E402
from dyadica import MetricEncoder  # noqa: E402
from dyadica.operators.encode import encode_table  # noqa: E402
from dyadica.operators.pairs import sample_pairs  # noqa: E402

PAIRS = 1 << 20


def _drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def encode_lines(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    _drain(encode_table(X.table(spark, sf, "lineitem"), names))


def index_lines(spark, sf):
    X.lines(spark, sf).size()


def line_pairs(spark, sf):
    source = X.lines(spark, sf)
    _drain(source.distances(sample_pairs(source, PAIRS, 1, "1"), PAIRS, None))


def vector_pairs(metric):
    def run(spark, sf):
        source = X.vectors(spark, sf)
        out = source.distances(sample_pairs(source, PAIRS, 1, "1"), PAIRS, metric)
        out.agg(F.corr(F.get("x", F.lit(0)), "d")).collect()

    return run


def fit_pooled(spark, sf):
    MetricEncoder(batch_size=PAIRS // 8, random_seed=1).fit(X.planted(spark, sf))


def fit_interactions(spark, sf):
    MetricEncoder(batch_size=PAIRS // 8, random_seed=1, interactions=True).fit(X.planted(spark, sf))


def fit_steps(spark, sf):
    MetricEncoder(batch_size=4096, max_steps=200, random_seed=1, solver="steps").fit(X.planted(spark, sf))


def fit_vectors(spark, sf):
    MetricEncoder(batch_size=PAIRS // 8, random_seed=1).fit(X.described_vectors(spark, sf))


def batch_size(spark, sf):
    MetricEncoder(random_seed=1).estimate_batch_size(X.planted(spark, sf))


def score(spark, sf):
    encoder = MetricEncoder(batch_size=1 << 16, max_steps=1, random_seed=1).fit(X.planted(spark, sf))
    start = time.perf_counter()
    encoder.score()[0].collect()
    return time.perf_counter() - start


QUERIES = {
    "encode_lines": encode_lines,
    "index_lines": index_lines,
    "line_pairs": line_pairs,
    "euclidean": vector_pairs("euclidean"),
    "manhattan": vector_pairs("manhattan"),
    "cosine": vector_pairs("cosine"),
    "norm_diff": vector_pairs("norm_diff"),
    "batch_size": batch_size,
    "fit_pooled": fit_pooled,
    "fit_interactions": fit_interactions,
    "fit_vectors": fit_vectors,
    "fit_steps": fit_steps,
    "score": score,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    spark.read.parquet(f"{sf}/customer.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        own = QUERIES[name](spark, sf)
        times[name] = round(own if own is not None else time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "pairs": PAIRS,
            }
        )
    )


if __name__ == "__main__":
    main()
