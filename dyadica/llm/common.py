"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# ASCII white space, which parts words in every contract of this package.
WORD_CHARS = r"[^\x20\x09-\x0D]+"
# Numpy work is done on slices of about this many bytes of text.
CHUNK_BYTES = 1024 * 1024


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null becomes empty."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``chunk_bytes`` of text each; a longer text
    stands alone."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(name)))
    sizes = np.asarray(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > chunk_bytes:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


_releases: list[Callable[[], None]] = []


def take_over(release: Callable[[], None] | None) -> None:
    """Begin a piece of work in this worker: what other work holds is let go of, and memory given
    back."""
    if _releases and _releases[0] is not release:
        _releases.pop()()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # only some C libraries keep freed memory and can be asked to give it back
    if release is not None and not _releases:
        _releases.append(release)


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: StructType | str,
    release: Callable[[], None] | None = None, text: str | None = None,
) -> DataFrame:
    """Apply ``fn``, a batch to named columns, to every Arrow batch.

    With ``text``, the name of a text column, batches are cut into slices of bounded text first,
    and each slice gives a batch of its own, so that no more than a slice's results are held.
    ``release`` lets go of what the worker holds for this work. It is called when the worker, which
    all stages share, first does other work; until then the next partitions use it too.
    """
    kind = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(release)
        try:
            for batch in batches:
                for part in [batch] if text is None else slices(batch, text):
                    if part.num_rows and (out := fn(part)) is not None:
                        yield record_batch(out, kind)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def record_batch(columns: dict, kind: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in kind:
        values = columns[f.name]
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        arrays.append(values.cast(f.type) if isinstance(values, pa.Array) else pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=kind)


def with_fields(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """The kept columns of a table, then the fields of a DDL text."""
    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(ddl).fields)


def arrow_schema(schema: StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The rows as one struct ``_row``, beside the columns an operator reads: other columns cannot
    clash with what it adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`") for c in columns])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
