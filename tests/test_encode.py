import datetime as dt
import decimal
import math

import pytest
from pyspark.sql import functions as F, types as T

from dyadica.functions.distances import CATEGORICAL, NUMERIC
from dyadica.operators.encode import (
    classify, encode_codes, encode_table, scaled, scaling_bounds,
)
from dyadica.session import BROADCAST_BYTES_KEY


def test_types(spark):
    schema = T.StructType(
        [
            T.StructField("i", T.IntegerType()), T.StructField("d", T.DoubleType()),
            T.StructField("dec", T.DecimalType(10, 2)), T.StructField("b", T.BooleanType()),
            T.StructField("s", T.StringType()), T.StructField("day", T.DateType()),
            T.StructField("ts", T.TimestampType()), T.StructField("arr", T.ArrayType(T.DoubleType())),
            T.StructField("iv", T.DayTimeIntervalType()),
        ]
    )
    kinds = [f.kind for f in classify(schema, ["i", "d", "dec", "b", "s", "day", "ts"])]
    assert kinds == [NUMERIC] * 3 + [CATEGORICAL] * 4
    assert classify(schema, ["i"], ["i"])[0].kind == CATEGORICAL
    for bad in ("arr", "iv"):
        with pytest.raises(TypeError):
            classify(schema, [bad])
    with pytest.raises(ValueError):
        classify(schema, ["absent"])


def encoded(df, columns, **kw):
    return [r.asDict() for r in encode_table(df, columns, **kw).orderBy("id").collect()]


def test_scale_missing_and_constant(spark):
    df = spark.createDataFrame(
        [(0, 2.0, 5.0), (1, None, 5.0), (2, float("nan"), 5.0), (3, 4.0, None), (4, 3.0, 5.0)],
        "id int, v double, c double",
    )
    rows = encoded(df, ["v", "c"])
    assert [r["v"] for r in rows] == [0.0, None, None, 1.0, 0.5]
    assert [r["c"] for r in rows] == [0.0, 0.0, 0.0, None, 0.0]


def test_all_missing_column(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "id int, v double")
    assert [r["v"] for r in encoded(df, ["v"])] == [None, None]


def test_infinite_values(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, math.inf)], "id int, v double")
    assert [r["v"] for r in encoded(df, ["v"])] == [0.0, 0.0, None]
    with pytest.raises(ValueError):
        encode_table(df, ["v"], strict=True)


def test_codes_follow_sorted_values(spark):
    df = spark.createDataFrame(
        [(0, "b", 10), (1, "a", 9), (2, None, 100), (3, "b", 9)], "id int, s string, n int"
    )
    rows = encoded(df, ["s", "n"], categorical=["n"])
    assert [r["s"] for r in rows] == [1.0, 0.0, None, 1.0]
    assert [r["n"] for r in rows] == [1.0, 0.0, 2.0, 0.0]


def test_other_types(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame(
        [(0, True, day, decimal.Decimal("1.00")), (1, False, dt.date(2019, 1, 1), decimal.Decimal("3.00"))],
        "id int, b boolean, day date, p decimal(10,2)",
    )
    rows = encoded(df, ["b", "day", "p"])
    assert [tuple(r[c] for c in ("b", "day", "p")) for r in rows] == [(1.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def test_codes_with_a_hot_value_and_a_large_dictionary(spark, conf):
    """Beyond the broadcast limit hot values are broadcast and rare ones shuffled."""
    df = spark.range(6000).select(
        F.col("id").cast("int").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 100 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("v"), F.lpad((F.col("id") % 2500).cast("string"), 5, "0")))
        .alias("s"),
    )
    want = {r["id"]: r["s"] for r in encode_codes(df, ["s"]).collect()}
    conf(BROADCAST_BYTES_KEY, 100)
    got_df = encode_codes(df, ["s"])
    got = {r["id"]: r["s"] for r in got_df.collect()}
    assert got == want and len(got) == 6000
    values = sorted({r["s"] for r in df.collect() if r["s"] is not None})
    assert got[0] == values.index("hot") and got[101] is None


def test_empty(spark):
    df = spark.createDataFrame([], "id int, v double, s string")
    assert encode_table(df, ["v", "s"]).count() == 0


def test_own_bounds_of_each_table(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 10.0)], "id int, v double")
    half = df.withColumn("v", F.col("v") / 2)
    for t in (df, half):
        b = scaling_bounds(t, classify(t.schema, ["v"]))
        assert sorted(r[0] for r in t.select(scaled("v", b)).collect()) == [0.0, 1.0]
