"""Whitening of embeddings on their leading principal components.

Vectors are held as whole numbers, x = floor(256 c) for every entry c. The fit list has every
distinct x vector once. Its sums and, about a whole-numbered centre near the mean, its products are
added up exactly on the executors, so the covariance on the driver is that of the list to the last
digit, however the list is spread. Its leading eigenvalues come from spectrum slicing
(``spectrum.py``). A last pass over the list measures the covariance of the whitened vectors.

What shuffles is one packed copy of each vector, two bytes an entry where its entries allow,
reduced to distinct ones before and after the shuffle; then matrices of one number a pair of
dimensions. The driver gets one such matrix.

Rows: a row is left out where its vector is null, holds a null or non-finite entry, has no entries,
has an entry beyond what 62 bits hold as x, or is not of the length that most distinct vectors
have (of lengths that tie, the longer). Null ids stay. Repeated rows and ids give a row each and
count once in the fit. Components whose variance is no more than rounding noise are left out: a
list of one vector has none, and its rows give no result. An empty table gives none. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dyadica.llm.common import map_arrow
from dyadica.llm.spectrum import leading
from dyadica.session import materialize

# Fixed value: whole steps of an entry of 1.
STEPS = 256
COMPONENTS = 4
WIDTHS = (2, 4, 8)
LARGEST = 1 << 62
# Products of whole numbers are exact in doubles below this.
EXACT = 1 << 53
# Digits in which sums beyond 64 bits are added up.
LIMB_BITS = 30
# Rows whose products are made at once.
BLOCK_ROWS = 4096


@dataclass
class Whitening:
    """n distinct vectors, their sums, the components as columns and their variances."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-numbered rows."""
        return self.centred(x) @ (self.components / np.sqrt(self.variances))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from the whole number n x - S."""
        return np.asarray(self.scaled(x) / self.n, dtype=float)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S; as Python's numbers where 64 bits may not hold it."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max((abs(int(s)) for s in self.sums), default=0)
        if most >= LARGEST:
            return x.astype(object) * self.n - self.sums
        return x * self.n - self.sums.astype(np.int64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squares of n x - S a row; null where a long does not hold it."""
        y = self.scaled(x)
        most = int(np.abs(y).max(initial=0))
        if most * most * max(1, y.shape[1]) >= LARGEST:
            exact = (y.astype(object) ** 2).sum(axis=1).tolist()
            return [d if d < 1 << 63 else None for d in exact]
        return (y * y).sum(axis=1).tolist()


def whole_numbers(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable rows of a column of vectors, a length at a time (or of one length): places, x."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    flat = np.asarray(values.fill_null(np.nan), dtype=float)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes[sizes > 0]).tolist() if length is None else [length]:
        rows = np.flatnonzero(sizes == size)
        if size < 1 or not len(rows):
            continue
        entries = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        with np.errstate(invalid="ignore", over="ignore"):
            steps = np.floor(entries * STEPS)
            good = (np.abs(steps) < LARGEST).all(axis=1)
        yield rows[good], steps[good].astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry; equal rows become equal bytes."""
    most = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
    out: list[bytes] = [b""] * len(x)
    width = np.select([most < 1 << (8 * w - 1) for w in WIDTHS[:-1]], WIDTHS[:-1], WIDTHS[-1])
    for w in WIDTHS:
        rows = np.flatnonzero(width == w)
        for k, row in zip(rows.tolist(), x[rows].astype(f"<i{w}")):
            out[k] = row.tobytes()
    return out


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """Rows of packed vectors of one length."""
    out = np.empty((len(column), size), dtype=np.int64)
    values = column.to_pylist()
    widths = np.array([len(v) // size for v in values])
    for w in WIDTHS:
        rows = np.flatnonzero(widths == w)
        if len(rows):
            out[rows] = np.frombuffer(b"".join([values[k] for k in rows.tolist()]), dtype=f"<i{w}").reshape(-1, size)
    return out


def fit_list(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The distinct packed vectors ``x`` of the most frequent length, and that length."""

    def run(batch: pa.RecordBatch) -> dict:
        found = list(whole_numbers(batch.column(0)))
        return {
            "size": np.concatenate([np.full(len(x), x.shape[1]) for _, x in found] or [np.zeros(0, dtype=int)]),
            "x": [p for _, x in found for p in packed(x)] if found else [],
        }

    rows = map_arrow(vectors.select(F.col(f"`{vector}`").cast("array<double>")), run, "size int, x binary")
    distinct = materialize(rows.distinct())
    # One row a length.
    sizes = distinct.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return distinct.filter(F.col("size") == size).select("x"), size


def add_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Exact sums of rows (row, values) of whole numbers by row: high and low digits are added
    apart, by tasks that each take some of the rows of the matrix."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.asarray(values.values)
                high = v >> LIMB_BITS
                both = np.concatenate([high, v - (high << LIMB_BITS)])
                totals[row] = totals[row] + both if row in totals else both
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.int64()))],
                names=["row", "digits"])

    summed = parts.repartition("row").mapInArrow(run, "row int, digits array<long>")
    out = {}
    for r in summed.collect():
        digits = np.array(r["digits"], dtype=object)
        half = len(digits) // 2
        out[r["row"]] = digits[:half] * (1 << LIMB_BITS) + digits[half:]
    return out


def exact_sums(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their sums."""

    def run(batches):
        # 62 bits an entry and fewer than 2^31 rows: digits apart.
        total = np.zeros((2, size), dtype=np.int64)
        n = 0
        for batch in batches:
            x = unpacked(batch.column(0), size)
            high = x >> LIMB_BITS
            total[0] += high.sum(axis=0)
            total[1] += (x - (high << LIMB_BITS)).sum(axis=0)
            n += len(x)
        if n:
            kept = [np.array([n], dtype=np.int64), total[0], total[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0, 1, 2], pa.int32()), pa.array(kept, pa.list_(pa.int64()))], names=["row", "values"])

    found = add_up(rows.mapInArrow(run, "row int, values array<long>"))
    if not found:
        return 0, np.zeros(size, dtype=object)
    return int(found[0][0]), found[1] * (1 << LIMB_BITS) + found[2]


def exact_products(rows: DataFrame, size: int, centre: list[int]) -> np.ndarray:
    """Sums over all vectors of the products of their entries less the centre's."""

    def run(batches):
        middle = np.array(centre, dtype=np.int64)
        total = np.zeros((size, size), dtype=np.int64)
        held, kind = 0, pa.schema([("row", pa.int32()), ("values", pa.list_(pa.int64()))])

        def out():
            offsets = pa.array(np.arange(0, size * size + 1, size, dtype=np.int32))
            values = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), values], schema=kind)

        for batch in batches:
            y = unpacked(batch.column(0), size) - middle
            most = max(1, int(np.abs(y).max(initial=0)))
            rows_exact = min(BLOCK_ROWS, EXACT // (most * most))
            if not rows_exact:
                # Entries of more than 26 bits: products of their digits, in exact blocks.
                for power, matrix in _wide_products(y):
                    row = pa.array(np.arange(size, dtype=np.int32) + size * (1 + power))
                    yield pa.RecordBatch.from_arrays([row, pa.array(list(matrix), pa.list_(pa.int64()))], schema=kind)
                continue
            for k in range(0, len(y), rows_exact):
                part = y[k : k + rows_exact].astype(float)
                bound = most * most * len(part)
                if held + bound >= LARGEST:
                    yield out()
                    total[:] = 0
                    held = 0
                total += (part.T @ part).astype(np.int64)
                held += bound
        if held:
            yield out()

    found = add_up(rows.mapInArrow(run, "row int, values array<long>"))
    out = np.zeros((size, size), dtype=object)
    for row, values in found.items():
        out[row % size] += values * (1 << (DIGIT_BITS * max(0, row // size - 1)))
    return out


# Digits of wide entries, and how many make 63 bits.
DIGIT_BITS, DIGITS = 21, 4


def _wide_products(y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(power, matrix): products of wide entries as sums of matrices times 2^(DIGIT_BITS * power)."""
    digits = [(y >> (DIGIT_BITS * k)) & ((1 << DIGIT_BITS) - 1) for k in range(DIGITS - 1)]
    digits.append(y >> (DIGIT_BITS * (DIGITS - 1)))
    rows = EXACT >> (2 * DIGIT_BITS + 1)
    for k in range(0, len(y), rows):
        parts = [d[k : k + rows].astype(float) for d in digits]
        for a in range(DIGITS):
            for b in range(DIGITS):
                yield a + b, (parts[a].T @ parts[b]).astype(np.int64)


def fit(vectors: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening:
    """Whitening of the table's distinct vectors on their leading ``components``."""
    rows, size = fit_list(vectors, vector)
    n, sums = exact_sums(rows, size) if size else (0, np.zeros(0, dtype=object))
    if not n:
        return Whitening(0, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    centre = [int(s) // n for s in sums]
    products = exact_products(rows, size, centre)
    rest = sums - n * np.array(centre, dtype=object)
    # n times the products less the product of sums is n^2 times the covariance, a whole number.
    scaled = n * products - np.multiply.outer(rest, rest)
    # Python divides whole numbers of any size to the closest double.
    covariance = np.array([[int(v) / (n * n) for v in row] for row in scaled])
    trace = int(scaled.trace()) / (n * n)
    variances, basis = leading(covariance, components)
    model = Whitening(n, sums, basis, variances, trace)
    model.identity_error = identity_error(rows, size, model)
    return model


def identity_error(rows: DataFrame, size: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened list's covariance less the identity, measured:
    means and centred products by batch, which are then put together."""
    k = len(model.variances)
    if not k:
        return 0.0

    def run(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            n, mean, spread = _together((n, mean, spread), _moments(model.project(unpacked(batch.column(0), size))))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], names=["n", "mean", "spread"])

    total = (0, np.zeros(k), np.zeros((k, k)))
    # One row a task.
    for r in sorted(rows.mapInArrow(run, "n long, mean array<double>, spread array<double>").collect()):
        total = _together(total, (r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def _moments(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = y.mean(axis=0)
    return len(y), mean, (y - mean).T @ (y - mean)


def _together(a, b):
    if not a[0]:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.multiply.outer(gap, gap) * (a[0] * b[0] / n)


def transform(vectors: DataFrame, model: Whitening, id: str, vector: str) -> DataFrame:
    """A row for each usable vector and component: id, component (from 1), n, deviation, whitened,
    explained and identity_error. No shuffle."""
    k, size = len(model.variances), len(model.sums)
    fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    picked = vectors.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_vector"))
    explained = model.variances / model.trace if k else model.variances

    def run(batch: pa.RecordBatch) -> dict | None:
        found = [(rows, x) for rows, x in whole_numbers(batch.column(1), size) if len(rows)] if k else []
        if not found:
            return None
        rows, x = found[0]
        return {
            "_id": batch.column(0).take(pa.array(np.repeat(rows, k))),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)),
            "n": np.full(k * len(rows), model.n),
            "deviation": [d for d in model.deviation(x) for _ in range(k)],
            "whitened": model.project(x).ravel(),
            "explained": np.tile(explained, len(rows)),
            "identity_error": np.full(k * len(rows), model.identity_error),
        }

    kind = picked.schema["_id"].dataType.simpleString()
    done = map_arrow(picked, run, f"_id {kind}, {fields}")
    return done.select(F.col("_id").alias(id), *[f.split()[0] for f in fields.split(", ")])


def whiten(vectors: DataFrame, id: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Fit on the table and transform it."""
    return transform(vectors, fit(vectors, vector, components), id, vector)
