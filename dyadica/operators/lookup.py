"""Equi-join to a dictionary whose keys may be very unevenly used."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dyadica.sources.sizing import fits_broadcast

# A key used by more than 1/HOT_SHARE of the rows is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def join_dictionary(
    fact: DataFrame, dictionary: DataFrame, key: str, used: str, n_keys: int
) -> DataFrame:
    """Left join ``fact`` to ``dictionary`` on ``key``.

    ``used`` is a dictionary column holding how many fact rows use the key. A dictionary
    measured to fit is broadcast. Otherwise the hot keys, at most ``HOT_SHARE`` of them, are
    broadcast, and only rows with rare keys are shuffled, so no task gets a hot key.
    """
    if fits_broadcast(dictionary, n_keys):
        return fact.join(F.broadcast(dictionary.drop(used)), key, "left")
    n_rows = dictionary.agg(F.sum(used).alias("n")).first()["n"] or 0
    hot = dictionary.filter(F.col(used) * HOT_SHARE > F.lit(n_rows)).drop(used)
    hot = hot.select(key, F.struct(*[c for c in hot.columns if c != key]).alias("_hot"))
    names = [c for c in dictionary.columns if c not in (key, used)]
    tagged = fact.join(F.broadcast(hot), key, "left")
    by_hot = tagged.filter(F.col("_hot").isNotNull() | F.col(key).isNull()).select(
        *fact.columns, *[F.col(f"_hot.{c}").alias(c) for c in names]
    )
    rare = tagged.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot")
    by_rare = rare.join(dictionary.drop(used), key, "left").select(*fact.columns, *names)
    return by_hot.unionByName(by_rare)
