"""A long table of precomputed pair distances (i, j, x..., y)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dyadica.functions import distances as D
from dyadica.functions.hashing import draw_numbers, index_of
from dyadica.operators import pairs as P
from dyadica.operators.index import global_position
from dyadica.sources.sizing import fits_broadcast
from dyadica.sources.stimuli import array_width


# Fixed value: a prime of 31 bits.
PRIME = (1 << 31) - 1


def _mark(position: Column, kind: int) -> Column:
    """A random-like number below 2^30 for a position."""
    return F.hash(F.lit(kind), position.cast("bigint")).cast("bigint").bitwiseAND(F.lit((1 << 30) - 1))


def _given(distance: Column) -> Column:
    """A distance as a double; one that is missing raises, since nothing is filled here."""
    value = distance.cast("double")
    missing = F.raise_error(F.lit("a precomputed distance is NULL or NaN")).cast("double")
    return F.when(value.isNull() | F.isnan(value), missing).otherwise(value)


class PrecomputedPairs:
    """Distances of the ordered pairs of n stimuli, one row per pair.

    ``features`` names distance columns, or one array column of them. Distances are taken as
    they are: nothing is scaled, filled or clipped before squaring.

    A ``complete`` table is a full matrix: every pair of 0..n-1, self-pairs included. It has
    n*n rows, so for many stimuli pass a list of pairs with ``complete=False``; batches are
    then drawn uniformly over its rows, which for a full matrix is the same distribution.
    """

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str] | str,
        target: str | None = None,
        i: str = "i",
        j: str = "j",
        feature_names: Sequence[str] | None = None,
        complete: bool = True,
    ) -> None:
        self.df, self.i, self.j, self.target = df, i, j, target
        self.complete = complete
        missing = [c for c in (i, j, target) if c is not None and c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}")
        if isinstance(features, str):
            if not isinstance(df.schema[features].dataType, T.ArrayType):
                raise TypeError("features must be one array column or a list of columns")
            p = array_width(df, features)
            self._x = [F.get(F.col(features), F.lit(k)) for k in range(p)]
            names = [f"feature_{k}" for k in range(p)]
        else:
            self._x = [F.col(c) for c in features]
            names = list(features)
        self.feature_names = [str(f) for f in (feature_names or names)]
        if len(self.feature_names) != len(self._x):
            raise ValueError(f"{len(self._x)} features but {len(self.feature_names)} names")
        self._n = None
        self._index = None
        self._small = None

    @property
    def n_features(self) -> int:
        return len(self._x)

    def size(self) -> int:
        """n of a complete matrix, or the number of listed pairs."""
        if self._n is None:
            self._n = self._matrix_size() if self.complete else self._list_size()
        return self._n

    def _matrix_size(self) -> int:
        i, j = F.col(self.i), F.col(self.j)
        # Over a full matrix, the products of both ends' marks add up to the product of the marks'
        # sums; a pair that stands in for another changes that, but for a chance of about 2^-62.
        marks = [(_mark(i, k) * _mark(j, k + 2) % PRIME).cast("decimal(10,0)") for k in range(2)]
        row = self.df.agg(
            F.count(F.lit(1)).alias("c"), F.min(F.least(i, j)).alias("lo"),
            F.max(F.greatest(i, j)).alias("hi"), F.count(i + j).alias("k"),
            *[F.sum(m).alias(f"s{k}") for k, m in enumerate(marks)],
        ).first()
        n = 0 if row["c"] == 0 else int(row["hi"]) + 1
        if row["c"] != n * n or row["k"] != row["c"] or (n and row["lo"] != 0):
            raise ValueError(
                f"precomputed distances need every pair of 0..{n - 1}: "
                f"{n * n} rows expected, {row['c']} found"
            )
        ids = self.df.sparkSession.range(n)
        want = ids.agg(*[F.sum(_mark(F.col("id"), k).cast("decimal(10,0)")) for k in range(4)]).first()
        for k in range(2):
            if n and int(row[f"s{k}"]) % PRIME != int(want[k]) * int(want[k + 2]) % PRIME:
                raise ValueError("precomputed distances repeat some pairs and lack others")
        return n

    def _list_size(self) -> int:
        # The distances are stored next to the numbered pairs, so that one join brings both.
        values = F.struct(*self._terms(), *self._distance())
        rows = self.df.select(
            F.col(self.i).cast("bigint").alias("i"), F.col(self.j).cast("bigint").alias("j"), values.alias("_given")
        )
        self._index, n = global_position(rows, ["i", "j"], "_row", unique=True, carry=["_given"])
        return n

    def _terms(self) -> list[Column]:
        return [_given(c).alias(f"_d{k}") for k, c in enumerate(self._x)]

    def _distance(self) -> list[Column]:
        return [] if self.target is None else [_given(F.col(self.target)).alias("d")]

    def draw(self, pairs: DataFrame, stream: str, n_pairs: int | None = None) -> DataFrame:
        """Add i and j, uniform over the matrix or over the listed pairs, which bring their
        distances along as ``_given``.

        A list that fits is broadcast; few pairs are broadcast to a large list instead, which is
        then never shuffled.
        """
        n = self.size()
        if self.complete:
            return P.draw_ends(pairs, n, stream)
        if n == 0:
            raise ValueError("cannot sample pairs from an empty table")
        drawn = draw_numbers(pairs, stream, "pair_id", "_a")
        rows = drawn.select(*pairs.columns, index_of("_a", n).alias("_row"))
        if n_pairs is None or self.is_small():
            mode = "shuffle"
            index = F.broadcast(self._index) if self.is_small() else self._index
        else:
            mode, index = P.meeting_mode(self.df.sparkSession, n, n_pairs), self._index
        return P.meet(index, rows, ["_row"], mode).select(*pairs.columns, "i", "j", "_given")

    def draws_ends(self) -> bool:
        """Whether pairs are drawn by their ends, each of n*n alike; else by their place in a list."""
        return self.complete

    def distances(
        self,
        pairs: DataFrame,
        n_pairs: int,
        distance: str | Callable | None = D.PRECOMPUTED,
        interactions: bool = False,
        nan_to_num: float = 0.0,
        mode: str = "auto",
        expand: bool = True,
    ) -> DataFrame:
        """Look up ``x`` and ``d`` of every pair.

        A small table is broadcast to the pairs; otherwise few pairs, or their keys, are
        broadcast to the table, and only many pairs make it shuffle.
        """
        if distance not in (None, D.PRECOMPUTED):
            raise ValueError("precomputed pairs need distance='precomputed'")
        if distance is not None and self.target is None:
            raise ValueError("this pair table has no representation distance")
        columns = [c for c in pairs.columns if c != "_given"]
        d = self._distance() if distance is not None else []
        if "_given" in pairs.columns:
            base = [F.col(f"_given._d{k}") for k in range(self.n_features)]
            x = D.terms_array(base, interactions) if expand else F.array(*base)
            return pairs.select(*columns, x.alias("x"), *([F.col("_given.d").alias("d")] if d else []))
        terms = self._terms()
        table = self.df.select(
            F.col(self.i).cast("bigint").alias("i"), F.col(self.j).cast("bigint").alias("j"), *terms, *d
        )
        if mode in ("auto", "packed"):
            mode = "lookup" if self.is_small() else P.meeting_mode(
                self.df.sparkSession, self._rows(), n_pairs
            )
        if mode == "lookup":
            met = pairs.join(F.broadcast(table), ["i", "j"])
        else:
            met = P.meet(table, pairs, ["i", "j"], mode)
        base = [F.col(f"_d{k}") for k in range(self.n_features)]
        x = D.terms_array(base, interactions) if expand else F.array(*base)
        return met.select(*columns, x.alias("x"), *(["d"] if d else []))

    def is_small(self, metric=None) -> bool:
        """True when the whole table is measured to fit a broadcast."""
        if self._small is None:
            self._small = fits_broadcast(self.df, self._rows())
        return self._small

    def _rows(self) -> int:
        n = self.size()
        return n * n if self.complete else n
