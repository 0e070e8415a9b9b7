"""A table of stimuli as a source of pair distances."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dyadica.functions import distances as D, kernels as K
from dyadica.operators import pairs as P
from dyadica.operators.encode import CATEGORICAL, Feature, classify, pair_values, scaling_bounds
from dyadica.operators.index import global_position
from dyadica.operators.packed import gather_packed, packable, packed_parts
from dyadica.session import broadcast_bytes
from dyadica.sources.sizing import fits_broadcast, widest_row

# Modes of meeting the stimuli that leave the choice to their sizes.
AUTO = ("auto", "packed")


def vector_column(df: DataFrame, target: str | Sequence[str]) -> Column:
    """A representation as one array of doubles.

    A scalar column becomes a one-element array, nested arrays are flattened, and several
    columns become one array in their order.
    """
    if not isinstance(target, str):
        parts = [vector_column(df, t) for t in target]
        return F.concat(*parts)
    col, dtype = F.col(target), df.schema[target].dataType
    if not isinstance(dtype, T.ArrayType):
        if not isinstance(dtype, (T.NumericType, T.BooleanType)):
            raise TypeError(f"representation {target!r} is {dtype.simpleString()}")
        return F.array(col.cast("double"))
    while isinstance(dtype.elementType, T.ArrayType):
        col, dtype = F.flatten(col), dtype.elementType
    return col.cast("array<double>")


def align(x: DataFrame, y: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Join features and representations on ``key``; every row must find its partner."""
    keys = [key] if isinstance(key, str) else list(key)
    n_x, n_y = x.count(), y.count()
    if n_x != n_y:
        raise ValueError(f"X and Y differ in rows: {n_x} and {n_y}")
    for name, side in (("X", x), ("Y", y)):
        if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} repeats some of its {keys}")
    joined = x.join(y, keys)
    n = joined.count()
    if n != n_x:
        raise ValueError(f"only {n} of {n_x} rows of X and Y share their {keys}")
    return joined


def array_width(df: DataFrame, column: str) -> int:
    """The common length of all arrays of a column; a NULL array is a row without values."""
    size = F.when(F.col(column).isNotNull(), F.size(column))
    row = df.agg(F.min(size).alias("lo"), F.max(size).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"arrays of {column!r} have {row['lo']} to {row['hi']} numbers")
    return row["lo"] or 0


class Stimuli:
    """Named features and an optional representation per row.

    ``features`` names feature columns, or one ``array`` column of raw numbers, which is not
    scaled. ``id`` names columns that tell the rows apart. ``dense=True`` says that the id
    already is 0..n-1, which saves sorting the ids.
    """

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str] | str,
        target: str | Sequence[str] | None = None,
        id: str | Sequence[str] = "id",
        categorical: Sequence[str] = (),
        feature_names: Sequence[str] | None = None,
        dense: bool = False,
        scale: bool = True,
        strict: bool = False,
    ) -> None:
        self.df = df
        self.keys = [id] if isinstance(id, str) else list(id)
        self.target = target
        self.dense = dense
        self.scale = scale
        self.strict = strict
        self.raw = isinstance(features, str)
        self.columns = [features] if self.raw else list(features)
        self.categorical = tuple(categorical)
        if self.raw:
            if not isinstance(df.schema[features].dataType, T.ArrayType):
                raise TypeError("raw features must be one array column")
            p = array_width(df, features)
            self.kinds = [Feature(features, D.NUMERIC)] * p
            names = [f"feature_{k}" for k in range(p)]
        else:
            self.kinds = classify(df.schema, self.columns, self.categorical)
            names = self.columns
        self.feature_names = [str(f) for f in (feature_names or names)]
        if len(self.feature_names) != len(self.kinds):
            raise ValueError(f"{len(self.kinds)} features but {len(self.feature_names)} names")
        self._bounds = None
        self._index = None
        self._id_bytes = None
        self._n = None
        self._small: dict[tuple, bool] = {}
        self._matrix = None
        self._matrix_made = False

    @property
    def n_features(self) -> int:
        return len(self.kinds)

    def replace(self, df: DataFrame) -> "Stimuli":
        """The same description over other rows, scaled on their own bounds."""
        dense = False
        features = self.columns[0] if self.raw else self.columns
        return Stimuli(
            df, features, self.target, self.keys, self.categorical, self.feature_names,
            dense, self.scale, self.strict,
        )

    def with_target(self, target: str | Sequence[str] | None) -> "Stimuli":
        """The same rows, positions and features with another representation."""
        other = copy.copy(self)
        other.target, other._small, other._matrix, other._matrix_made = target, {}, None, False
        return other

    # ------------------------------------------------------------ positions

    def size(self) -> int:
        if self._n is None:
            if self.dense:
                key = F.col(self.keys[0])
                row = self.df.agg(
                    F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"),
                    F.sum(key.cast("decimal(20,0)")).alias("s"),
                    F.sum(F.expr(f"cast(`{self.keys[0]}` as decimal(19,0)) * `{self.keys[0]}`")).alias("s2"),
                ).first()
                n = row["n"]
                wrong = row["lo"] != 0 or row["hi"] != n - 1 or row["s"] != n * (n - 1) // 2
                if n and (wrong or row["s2"] != (n - 1) * n * (2 * n - 1) // 6):
                    raise ValueError(f"id {self.keys[0]!r} is not dense 0..{n - 1}")
                self._n = n
            else:
                # Plain columns are stored next to the positions, so that pairs meet them by position.
                plain = self._plain_columns()
                self._index, self._n = global_position(
                    self.df.select(*self.keys, *plain), self.keys, "sid", unique=True, carry=plain
                )
        return self._n

    def _plain_columns(self) -> list[str]:
        """Columns of the distances other than ids and arrays."""
        found = [c for c in self._needed(None, []) if c not in self.keys]
        if self.target is not None:
            found += [self.target] if isinstance(self.target, str) else list(self.target)
        wide = (T.ArrayType, T.MapType, T.StructType)
        return [
            c for c in dict.fromkeys(found) if c not in self.keys and not isinstance(self.df.schema[c].dataType, wide)
        ]

    def draw(self, pairs: DataFrame, stream: str, n_pairs: int | None = None) -> DataFrame:
        """Add the ends of each pair, uniform over the stimuli."""
        return P.draw_ends(pairs, self.size(), stream)

    def draws_ends(self) -> bool:
        """Whether pairs are drawn by their ends, each of n*n alike."""
        return True

    def _with_sid(self) -> DataFrame:
        """All rows with their position; for tables small enough to broadcast."""
        if self.dense:
            return self.df.withColumn("sid", F.col(self.keys[0]).cast("bigint"))
        return self.df.join(F.broadcast(self._index.select(*self.keys, "sid")), self.keys)

    def _placed(self, columns: Sequence[str]) -> DataFrame:
        """All rows with their position and these columns, without a broadcast. Rows without an id
        match none, as in a join by ids."""
        if self.dense:
            return self.df.select(*columns, F.col(self.keys[0]).cast("bigint").alias("sid"))
        if set(columns) <= set(self._index.columns):
            return self._index.select(*columns, "sid").dropna("any", subset=self.keys)
        return self.df.select(*columns).join(self._index.select(*self.keys, "sid"), self.keys)

    # -------------------------------------------------------------- payload

    def _bounds_of(self) -> dict:
        if self._bounds is None:
            wanted = [] if self.raw or not self.scale else self.kinds
            self._bounds = scaling_bounds(self.df, wanted, self.strict)
        return self._bounds

    def _payload(
        self, df: DataFrame, metric: D.Metric | None, targets: Sequence, carry: Sequence[str] = ()
    ) -> dict[str, Column]:
        if self.raw:
            array = F.col(self.columns[0])
            values = [F.get(array, F.lit(k)).cast("double") for k in range(self.n_features)]
        else:
            values = pair_values(df, self.kinds, self._bounds_of(), self.scale)
        out = {f"f{k}": v for k, v in enumerate(values)}
        if metric is not None:
            for k, target in enumerate(targets):
                vector = vector_column(df, target)
                if metric.vector:
                    out[f"y{k}"] = vector
                if metric.norm:
                    out[f"norm{k}"] = D.vector_norm(vector)
        return out | {f"c_{c}": F.col(c) for c in carry}

    def _needed(self, metric: D.Metric | None, targets: Sequence, carry: Sequence[str] = ()) -> list[str]:
        wanted = [] if metric is None else [[t] if isinstance(t, str) else t for t in targets]
        return list(dict.fromkeys([*self.keys, *self.columns, *(c for t in wanted for c in t), *carry]))

    def is_small(
        self, metric: D.Metric | None = None, targets: Sequence | None = None, carry: Sequence[str] = ()
    ) -> bool:
        """True when the columns these distances need are measured to fit a broadcast."""
        narrow = self.df.select(*self._needed(metric, [self.target] if targets is None else targets, carry))
        key = tuple(narrow.columns)
        if key not in self._small:
            self._small[key] = fits_broadcast(narrow, self.size())
        return self._small[key]

    def matrix(self):
        """All representations as a broadcast matrix, one row a number; None where they differ in
        length or are measured not to fit KERNEL_BYTES."""
        if not self._matrix_made:
            self._matrix_made = True
            n, rows = self.size(), self._with_sid()
            vectors = rows.select("sid", vector_column(rows, self.target).alias("y"))
            size = F.when(F.col("y").isNotNull(), F.size("y"))
            found = vectors.agg(F.min(size).alias("lo"), F.max(size).alias("hi")).first()
            width = found["hi"] or 0
            limit = min(K.KERNEL_BYTES, broadcast_bytes(self.df.sparkSession))
            if width and found["lo"] == width and 8 * n * width <= limit:
                matrix = K.columns_of(vectors.toArrow(), n, width)
                self._matrix = self.df.sparkSession.sparkContext.broadcast(matrix)
        return self._matrix

    def _key_width(self) -> int:
        """Bytes of the widest id, where pair ends have to carry ids."""
        if self.dense:
            return 0
        if self._id_bytes is None:
            self._id_bytes = widest_row(self._index.select(*self.keys))
        return self._id_bytes

    def gather(
        self, pairs: DataFrame, n_pairs: int, metric: D.Metric | None, mode: str = "auto",
        targets: Sequence | None = None, carry: Sequence[str] = (),
    ) -> DataFrame:
        """Both sides of every pair, as columns a_* and b_*; ``carry`` names further columns of the
        rows, which come as a_c_* and b_c_*.

        - ``lookup``: the stimuli are measured to fit, and are broadcast; no shuffle.
        - ``ends``: the stimuli are large and the pairs few; the pair ends are broadcast, so
          the stimuli are scanned once and never shuffled.
        - ``semi``: only the wanted ids fit a broadcast; they cut the stimuli down to the
          wanted rows, which alone are shuffled.
        - ``shuffle``: both are large; the pairs meet the stimuli in a shuffle join for each end.
        - ``packed``: the mode that sizes ask for, where what would be shuffled travels packed, which
          takes less disk and more work.

        A mode that is asked for broadcasts only what fits. Where the ends do not, they meet the
        stimuli in a shuffle; where the wanted ids do not, they cut the stimuli down in one.
        """
        n = self.size()
        targets = [self.target] if targets is None else targets
        packed = mode == "packed"
        if mode in AUTO:
            if self.is_small(metric, targets, carry):
                mode = "lookup"
            else:
                mode = P.meeting_mode(self.df.sparkSession, n, n_pairs, self._key_width())
        if mode == "lookup":
            rows = self._with_sid()
            payload = self._payload(rows, metric, targets, carry)
            values = rows.select("sid", *[c.alias(k) for k, c in payload.items()])
            return P.gather_by_lookup(pairs, values)
        needed = self._needed(metric, targets, carry)
        if mode == "shuffle" or not P.fits_ends(self.df.sparkSession, n_pairs, mode, self._key_width()):
            rows = self._placed(needed)
            if mode == "semi":
                rows = P.wanted_rows(rows, pairs)
            payload = self._payload(rows, metric, targets, carry)
            values = rows.select("sid", *[c.alias(k) for k, c in payload.items()])
            if packed and packable(values.schema) and packable(pairs.schema):
                return gather_packed(pairs, values, n, packed_parts(self.df.sparkSession, n, n_pairs))
            return P.gather_by_shuffle(pairs, values)
        keys = [c for c in pairs.columns if c not in ("i", "j")]
        rows = self.df.select(*needed)
        ends = P.pair_ends(pairs)
        if self.dense:
            rows, on = rows.withColumn("sid", F.col(self.keys[0]).cast("bigint")), ["sid"]
        else:
            ends, on = P.meet(self._index.select(*self.keys, "sid"), ends, ["sid"], mode), self.keys
        met = P.meet(rows, ends, on, mode)
        payload = self._payload(met, metric, targets, carry)
        met = met.select(*keys, "side", "sid", *[c.alias(k) for k, c in payload.items()])
        return P.assemble_ends(met, keys, list(payload))

    # ------------------------------------------------------------ distances

    def feature_distances(self, nan_to_num: float = 0.0) -> list[Column]:
        return [
            D.feature_distance(f.kind, F.col(f"a_f{k}"), F.col(f"b_f{k}"), nan_to_num)
            for k, f in enumerate(self.kinds)
        ]

    def distances(
        self,
        pairs: DataFrame,
        n_pairs: int,
        distance: str | Callable | None = "euclidean",
        interactions: bool = False,
        nan_to_num: float = 0.0,
        mode: str = "auto",
        expand: bool = True,
        targets: Sequence | None = None,
        carry: Sequence[str] = (),
    ) -> DataFrame:
        """Add ``x`` (array of squared distances or products) and ``d`` to the pairs.

        With ``distance=None`` only the features are read. With ``expand=False`` ``x`` holds
        the plain feature distances. Named distances of small stimuli are made by matrix
        operations on whole batches of pairs. With ``targets``, a list of representations, ``d``
        is an array of the distances in each. ``carry`` names columns of the rows that are added
        for both sides, as a_c_* and b_c_*.
        """
        metric, many = None, targets is not None
        if distance is not None:
            metric = D.resolve_metric(distance)
            targets = targets if many else [self.target]
            if any(t is None for t in targets):
                raise ValueError("these stimuli have no representation")
        asked = [*pairs.columns, *(f"{side}_c_{c}" for c in carry for side in "ab")]
        views = [self.with_target(t) for t in targets] if many else [self]
        by_kernel = (
            metric is not None and metric.name in K.KERNELS and mode in AUTO
            and self.is_small(metric, targets, carry) and all(v.matrix() is not None for v in views)
        )
        if by_kernel:
            names = [f"_d_{k}" for k in range(len(views))]
            pairs = K.with_distances(pairs, [v.matrix() for v in views], metric.name, names)
            met, given = self.gather(pairs, n_pairs, None, "lookup", carry=carry), [F.col(c) for c in names]
        else:
            met = self.gather(pairs, n_pairs, metric, mode, targets, carry)
            given = [] if metric is None else [
                column.alias(f"_d_{k}") for k, column in enumerate(self._distance_columns(metric, len(targets)))
            ]
        dist = self.feature_distances(nan_to_num)
        wide = met.select(*asked, *[c.alias(f"_d{k}") for k, c in enumerate(dist)], *given)
        base = [F.col(f"_d{k}") for k in range(len(dist))]
        x = D.terms_array(base, interactions) if expand else F.array(*base)
        d = [D.clean_distance(F.col(f"_d_{k}"), nan_to_num) for k in range(len(given))]
        d = [] if metric is None else [(F.array(*d) if many else d[0]).alias("d")]
        return wide.select(*asked, x.alias("x"), *d)

    def _distance_columns(self, metric: D.Metric, count: int) -> list[Column]:
        out = []
        for k in range(count):
            sides = [
                D.Side(
                    F.col(f"{s}_y{k}") if metric.vector else None,
                    F.col(f"{s}_norm{k}") if metric.norm else None,
                )
                for s in ("a", "b")
            ]
            out.append(metric.between(*sides))
        return out
