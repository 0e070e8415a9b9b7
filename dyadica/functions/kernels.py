"""Distances of many pairs at once, against one matrix of all representations.

The matrix is held column by column, and the terms of a distance are added in the order of the
numbers, as the column expressions add them, so both give the same digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from dyadica.functions.distances import COSINE_EPS

# A matrix is handed to all tasks up to this size.
KERNEL_BYTES = 64 * 1024 * 1024


def _sum(columns: np.ndarray, i: np.ndarray, j: np.ndarray, term) -> np.ndarray:
    total = np.zeros(len(i))
    a, b = np.empty(len(i)), np.empty(len(i))
    for column in columns:
        np.take(column, i, out=a)
        np.take(column, j, out=b)
        total += term(a, b)
    return total


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    np.subtract(a, b, out=a)
    return np.multiply(a, a, out=a)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(np.subtract(a, b, out=a), out=a)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.multiply(a, b, out=a)


def norms(columns: np.ndarray) -> np.ndarray:
    total = np.zeros(columns.shape[1])
    for column in columns:
        total += column * column
    return np.sqrt(total)


def euclidean(columns, lengths, i, j):
    return np.sqrt(_sum(columns, i, j, _square))


def manhattan(columns, lengths, i, j):
    return _sum(columns, i, j, _gap)


def cosine(columns, lengths, i, j):
    size = np.maximum(lengths, COSINE_EPS)
    return 1.0 - _sum(columns, i, j, _product) / (size[i] * size[j])


KERNELS = {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine}


def columns_of(rows: pa.Table, n: int, width: int) -> np.ndarray:
    """The matrix of vectors by position, one row a number, from (sid, y); missing is NaN."""
    matrix = np.full((width, n), np.nan)
    for batch in rows.to_batches():
        sid, y = np.asarray(batch.column(0)), batch.column(1)
        whole = np.flatnonzero(np.asarray(y.is_valid()))
        flat = np.asarray(y.flatten().fill_null(np.nan), dtype=float)
        matrix[:, sid[whole]] = flat.reshape(len(whole), width).T
    return matrix


def with_distances(pairs: DataFrame, matrices: list, metric: str, names: list[str]) -> DataFrame:
    """Add the distances between the positions i and j in each of the broadcast matrices."""
    kernel = KERNELS[metric]

    def run(batches):
        held = [m.value for m in matrices]
        lengths = [norms(m) if metric == "cosine" else None for m in held]
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                at = [batch.schema.get_field_index(c) for c in ("i", "j")]
                i, j = (np.asarray(batch.column(k)) for k in at)
                d = [pa.array(kernel(m, size, i, j)) for m, size in zip(held, lengths)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *d], names=[*batch.schema.names, *names])

    added = [T.StructField(name, T.DoubleType()) for name in names]
    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, *added]))
