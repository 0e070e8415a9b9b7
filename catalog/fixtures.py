"""Stimuli built from the given tables, whole, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dyadica import PrecomputedPairs, Stimuli
from dyadica.operators.encode import Feature, scaled, scaling_bounds
from dyadica.operators.pairs import sample_pairs

# The market segments of the customer table.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# Planted squared weights of the balance, segment and parity features.
PLANTED = (0.6, 0.3, 0.1)
# What the customers' second vectors hold of balance and parity.
SECOND = (0.5, 0.8)
# Lines of an order repeat; these columns together tell them apart.
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(col: Column) -> Column:
    return F.round(col, 6) + F.lit(0.0)


def planted(spark: SparkSession, sf: str, columns=("f1", "f2", "f3", "f4")) -> Stimuli:
    """Customers whose vectors hold known weights of balance, segment and parity."""
    customer = table(spark, sf, "customer")
    bounds = scaling_bounds(customer, [Feature("c_acctbal", "numeric")])
    f1 = scaled("c_acctbal", bounds)
    parity = (F.col("c_nationkey") % 2).cast("double")
    parts = [F.lit(PLANTED[0] ** 0.5) * f1]
    parts += [
        F.lit((PLANTED[1] / 2) ** 0.5) * (F.col("c_mktsegment") == s).cast("double") for s in SEGMENTS
    ]
    parts.append(F.lit(PLANTED[2] ** 0.5) * parity)
    df = customer.select(
        "c_custkey",
        f1.alias("f1"),
        F.col("c_mktsegment").alias("f2"),
        parity.alias("f3"),
        F.col("c_nationkey").alias("f4"),
        F.array(*parts).alias("y"),
        F.array(F.lit(SECOND[0]) * f1, F.lit(SECOND[1]) * parity).alias("z"),
    )
    categorical = [c for c in ("f3", "f4") if c in columns]
    return Stimuli(df, list(columns), "y", "c_custkey", categorical=categorical, dense=True)


def customers(spark: SparkSession, sf: str) -> Stimuli:
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return Stimuli(
        df, ["c_acctbal", "c_mktsegment", "c_nationkey"], "c_acctbal", "c_custkey",
        categorical=["c_nationkey"], dense=True,
    )


def vectors(spark: SparkSession, sf: str) -> Stimuli:
    """Embeddings with their label; a plain 0..n-1 key."""
    return Stimuli(
        table(spark, sf, "embeddings"), ["label"], "embedding", "vec_id",
        categorical=["label"], dense=True,
    )


def described_vectors(spark: SparkSession, sf: str) -> Stimuli:
    """All embeddings, by the language, source and length of their document where they have one."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    df = table(spark, sf, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    return Stimuli(df, ["lang", "source", "n_chars"], "embedding", "vec_id")


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


def parts(spark: SparkSession, sf: str) -> Stimuli:
    return Stimuli(
        table(spark, sf, "part"), ["p_brand", "p_type"], ["p_size", "p_retailprice"], "p_partkey",
        dense=True,
    )


def lines(spark: SparkSession, sf: str) -> Stimuli:
    df = table(spark, sf, "lineitem")
    return Stimuli(
        df,
        ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"],
        ["l_tax", "l_discount"],
        LINE_KEYS,
    )


# Fixed value: what fit_offset adds to every distance; spreads on it need centred sums.
OFFSET = 1e4


# Squared weights of gap, both together and mismatch in the listed distances; and
# such as no semidefinite matrix has.
LISTED, OUTSIDE = (0.5, 0.3, 0.3), (0.5, 0.9, 0.1)
# Squared distances of the list with a bound: a constant, gap, mismatch and nation.
BOUNDED = (0.6, 0.5, 0.3, -0.4)


def bounded_pairs(spark: SparkSession, sf: str) -> PrecomputedPairs:
    """A list of customer pairs whose distances shrink where the nations differ."""
    source = customers(spark, sf)
    n_pairs = 4 * source.size()
    drawn = source.distances(sample_pairs(source, n_pairs, 1, "7"), n_pairs, None)
    x = [F.sqrt(F.get("x", F.lit(k))) for k in range(3)]
    y = F.lit(BOUNDED[0])
    for w, d in zip(BOUNDED[1:], x):
        y = y + F.lit(w) * d * d
    names = ["gap", "mismatch", "nation"]
    df = drawn.select("i", "j", *[c.alias(n) for c, n in zip(x, names)], F.sqrt(y).alias("y")).distinct()
    return PrecomputedPairs(df, names, "y", complete=False)


def listed_pairs(
    spark: SparkSession, sf: str, offset: float = 0.0, weights: tuple[float, float, float] = LISTED
) -> PrecomputedPairs:
    """A list of customer pairs with their distances: x = (gap, mismatch), y with interaction."""
    source = customers(spark, sf)
    n_pairs = 4 * source.size()
    drawn = source.distances(sample_pairs(source, n_pairs, 1, "7"), n_pairs, None)
    d1, d2 = F.sqrt(F.get("x", F.lit(0))), F.sqrt(F.get("x", F.lit(1)))
    a, b, c = (F.lit(w) for w in weights)
    y = F.sqrt(a * d1 * d1 + b * d1 * d2 + c * d2 * d2)
    y = y + F.lit(offset)
    df = drawn.select("i", "j", d1.alias("gap"), d2.alias("mismatch"), y.alias("y")).distinct()
    return PrecomputedPairs(df, ["gap", "mismatch"], "y", complete=False)
