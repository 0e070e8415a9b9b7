"""Second moments of pair features, summed on the executors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Positions in a moment vector: bounds of the distance, the largest feature value, the
# count, then sums, then lower-triangle sums of products.
LOW, HIGH, TOP, COUNT, SUMS = range(5)

# Up to this many columns the products are plain aggregate expressions. Measured on a million
# pairs: at 6 columns expressions win; matrix products win from 10 on, by 7 times at 22, but
# have Python workers to start.
EXPRESSION_COLUMNS = 12


def vector_length(m: int) -> int:
    return SUMS + m + m * (m + 1) // 2


def moment_vectors(
    df: DataFrame,
    q: int,
    extras: Sequence[str] = (),
    by: Sequence[str] = (),
    base: int | None = None,
    centre: Sequence[float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Moments of ``x[0..q-1]`` and ``extras`` per ``by``, as rows (by..., pos, value).

    ``centre``, one number a column, is subtracted before anything is summed, so that spreads on
    large means keep their digits; the bounds are those of the values as they are.
    The first extra is the representation distance whose bounds are kept. With ``base``,
    ``x`` holds that many plain distances, and their q lower-triangle products are formed
    next to the sums, so that only the plain distances travel. ``weight`` names a column that says
    how often each row counts.
    """
    if base is None and use_expressions(q, extras):
        return _by_expressions(df, q, extras, by, centre, weight)
    return _by_arrow(df, q, extras, by, base, centre, weight)


def provisional_centre(dist: DataFrame, width: int, with_distance: bool) -> np.ndarray:
    """Means of ``x`` and, last, of ``d`` over a few pairs: good enough to subtract."""
    means = [F.avg(F.get("x", F.lit(k))).alias(f"_c{k}") for k in range(width)]
    row = dist.agg(*means, *([F.avg("d").alias("_d")] if with_distance else []))
    return np.array([0.0 if v is None else float(v) for v in row.first()])


def use_expressions(q: int, extras: Sequence[str]) -> bool:
    return q + len(extras) <= EXPRESSION_COLUMNS


def _by_expressions(df, q, extras, by, centre, weight):
    m = q + len(extras)
    x = F.col("x")
    cols = [F.get(x, F.lit(k)).alias(f"_v{k}") for k in range(q)]
    cols += [F.col(c).alias(f"_v{q + k}") for k, c in enumerate(extras)]
    times = F.lit(1.0) if weight is None else F.col("_times")
    counted = [] if weight is None else [F.col(weight).cast("double").alias("_times")]
    flat = df.select(*by, *cols, *counted)
    plain = [F.col(f"_v{k}") for k in range(m)]
    shift = [0.0] * m if centre is None else list(centre)
    v = [c - F.lit(float(s)) if s else c for c, s in zip(plain, shift)]
    d = plain[q] if extras else F.lit(0.0)
    top = F.greatest(*plain[:q]) if q > 1 else plain[0]
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(times)
    parts = [F.min(d), F.max(d), F.max(top), n]
    scaled = v if weight is None else [c * times for c in v]
    parts += [F.sum(c) for c in scaled]
    parts += [F.sum(scaled[r] * v[c]) for r in range(m) for c in range(r + 1)]
    sums = flat.groupBy(*by).agg(*[p.alias(f"_m{k}") for k, p in enumerate(parts)])
    packed = F.array(*[F.col(f"_m{k}") for k in range(len(parts))])
    return sums.select(*by, F.posexplode(packed).alias("pos", "value"))


def _by_arrow(df, q, extras, by, base, centre, weight):
    """Matrix products per Arrow batch; partial sums leave the task, never pairs."""
    m = q + len(extras)
    has_d = bool(extras)
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    names = list(by) or ["_all"]
    times = [] if weight is None else [F.col(weight).cast("double").alias("_times")]
    flat = df.select(key.alias("k"), "x", *extras, *times).select(
        *[F.col(f"k.{c}").cast("bigint").alias(c) for c in names], "x", *extras, *(["_times"] if times else [])
    )
    length = vector_length(m)
    extra_names = list(extras)
    width = base or q
    shift = None if centre is None else np.asarray(centre, dtype=float)
    # Partial sums held in a task before they are handed on.
    held = max(1, 64_000_000 // (8 * length))

    def partials(batches):
        rows, cols = np.tril_indices(m)
        left, right = np.tril_indices(width)
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            if not sums:
                return None
            keys = list(sums)
            arrays = [pa.array([k[c] for k in keys], pa.int64()) for c in range(len(names))]
            body = np.concatenate([sums[k] for k in keys])
            offsets = pa.array(np.arange(0, (len(keys) + 1) * length, length, dtype=np.int32))
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(body)))
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, [*names, "m"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if base is not None:
                x = x[:, left] * x[:, right]
            more = [batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in extra_names]
            v = np.hstack([x, *more]) if more else x
            often = batch.column("_times").to_numpy(zero_copy_only=False) if weight is not None else None
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            found, where = np.unique(keys, axis=0, return_inverse=True)
            where = where.reshape(-1)
            for g, k in enumerate(found):
                part = v[where == g] if len(found) > 1 else v
                counts = often if often is None or len(found) == 1 else often[where == g]
                vec = np.empty(length)
                vec[0] = part[:, q].min() if has_d else 0.0
                vec[1] = part[:, q].max() if has_d else 0.0
                vec[2] = part[:, :q].max()
                vec[3] = len(part) if counts is None else counts.sum()
                if shift is not None:
                    part = part - shift
                often_part = part if counts is None else part * counts[:, None]
                vec[4 : 4 + m] = often_part.sum(axis=0)
                vec[4 + m :] = (often_part.T @ part)[rows, cols]
                old = sums.get(tuple(k))
                if old is not None:
                    vec[3:] += old[3:]
                    vec[0] = min(vec[0], old[0])
                    vec[1:3] = np.maximum(vec[1:3], old[1:3])
                sums[tuple(k)] = vec
                if len(sums) >= held:
                    yield flush()
        last = flush()
        if last is not None:
            yield last

    schema = ", ".join(f"{c} bigint" for c in names) + ", m array<double>"
    long = flat.mapInArrow(partials, schema).select(*names, F.posexplode("m").alias("pos", "value"))
    return _merged(long, names).select(*by, "pos", "value")


def many_moments(
    df: DataFrame, q: int, n_targets: int, base: int | None, centres: np.ndarray, weight: str | None = None
) -> list["Moments"]:
    """Moments of ``x`` and of e and e*e for every distance e of the array ``d`` less its centre:
    what ``moment_vectors`` gives for each, with the sums of ``x`` made once.

    ``centres`` has a row a target: those of the terms, of d, and 0. ``base`` as there.
    """
    width = base or q
    m = q + 2
    length = vector_length(m)
    shift = np.asarray(centres, dtype=float)
    times = [] if weight is None else [F.col(weight).cast("double").alias("_times")]

    def partials(batches):
        left, right = np.tril_indices(width)
        rows, cols = np.tril_indices(m)
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            d = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_targets)
            often = np.ones(len(x)) if weight is None else batch.column(2).to_numpy(zero_copy_only=False)
            if base is not None:
                x = x[:, left] * x[:, right]
            top = x.max()
            x = x - shift[0, :q]
            weighed = x * often[:, None]
            shared_sum, shared = weighed.sum(axis=0), weighed.T @ x
            part = np.empty((n_targets, length))
            for k in range(n_targets):
                e = d[:, k] - shift[k, q]
                more = np.column_stack([e, e * e])
                often_more = more * often[:, None]
                full = np.empty((m, m))
                full[:q, :q] = shared
                full[q:, :q] = often_more.T @ x
                full[q:, q:] = often_more.T @ more
                part[k, :4] = d[:, k].min(), d[:, k].max(), top, often.sum()
                part[k, 4 : 4 + m] = np.concatenate([shared_sum, often_more.sum(axis=0)])
                part[k, 4 + m :] = full[rows, cols]
            if total is not None:
                part[:, 0] = np.minimum(part[:, 0], total[:, 0])
                part[:, 1:3] = np.maximum(part[:, 1:3], total[:, 1:3])
                part[:, 3:] += total[:, 3:]
            total = part
        if total is not None:
            offsets = pa.array(np.arange(0, n_targets * length + 1, length, dtype=np.int32))
            values = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_targets)), values], names=["target", "m"])

    parts = df.select("x", "d", *times).mapInArrow(partials, "target bigint, m array<double>")
    vectors = _merged(parts.select("target", F.posexplode("m").alias("pos", "value")), ["target"])
    found = collect_moments(vectors, m, "target")
    return [found[k] for k in range(n_targets)] if found else []


def _merged(long: DataFrame, names: list[str]) -> DataFrame:
    """Partial vectors (names..., pos, value) put together."""
    pos = F.col("pos")
    merged = long.groupBy(*names, "pos").agg(
        F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    value = F.when(pos == LOW, F.col("lo")).when(pos.isin(HIGH, TOP), F.col("hi")).otherwise(F.col("s"))
    return merged.select(*names, "pos", value.alias("value"))


@dataclass
class Moments:
    """Moments of one batch on the driver: numbers per feature pair, not per stimulus pair."""

    low: float
    high: float
    top: float
    n: float
    mean: np.ndarray
    cov: np.ndarray

    def merged(self, other: "Moments") -> "Moments":
        """Moments of both batches together; both must have the same centre."""
        n = self.n + other.n
        mean = (self.n * self.mean + other.n * other.mean) / n
        a, b = self.mean - mean, other.mean - mean
        cov = (self.n * (self.cov + np.outer(a, a)) + other.n * (other.cov + np.outer(b, b))) / n
        return Moments(
            min(self.low, other.low), max(self.high, other.high), max(self.top, other.top), n, mean, cov
        )

    def rescaled(self, factor: np.ndarray) -> "Moments":
        """Moments of the columns, each times its factor."""
        return Moments(
            self.low, self.high, self.top * float(np.max(factor, initial=1.0)), self.n,
            self.mean * factor, self.cov * np.outer(factor, factor),
        )


def unpack(vec: np.ndarray, m: int) -> Moments:
    n = vec[COUNT]
    mean = vec[SUMS : SUMS + m] / n
    rows, cols = np.tril_indices(m)
    raw = np.empty((m, m))
    raw[rows, cols] = raw[cols, rows] = vec[SUMS + m :] / n
    return Moments(vec[LOW], vec[HIGH], vec[TOP], n, mean, raw - np.outer(mean, mean))


def collect_moments(vectors: DataFrame, m: int, by: str | None = None) -> dict[int, Moments]:
    """Fetch the moment vectors, one per batch."""
    key = F.col(by).cast("bigint") if by else F.lit(0).cast("bigint")
    table = vectors.select(key.alias("k"), F.col("pos").cast("int").alias("pos"), "value").toArrow()
    keys = table.column("k").to_numpy()
    pos = table.column("pos").to_numpy()
    value = table.column("value").to_numpy()
    found, where = np.unique(keys, return_inverse=True)
    packed = np.zeros((len(found), vector_length(m)))
    packed[where, pos] = value
    return {int(k): unpack(packed[g], m) for g, k in enumerate(found)}


def scaled_square_moments(mom: Moments, q: int, low: float, high: float, eps: float):
    """Covariances of x with the scaled squared distance, from those with e and e*e, where e is
    the distance less its provisional centre; ``low`` and ``high`` are less the centre too.

    With s = (e - low) / r, s*s = (e*e - 2 low e + low*low) / r**2, so scaling by bounds that
    are known only after the pass needs no second pass over the pairs.
    """
    r2 = (high - low + eps) ** 2
    cov = mom.cov
    c = (cov[:q, q + 1] - 2 * low * cov[:q, q]) / r2
    var = (cov[q + 1, q + 1] - 4 * low * cov[q, q + 1] + 4 * low * low * cov[q, q]) / r2**2
    return cov[:q, :q], c, max(var, 0.0)
