"""Shuffles of packed rows.

A row in Spark's own shuffles takes 8 bytes and more for every column. Here the rows that go to the
same place travel as one Arrow batch, compressed column by column, numbers in as few bytes as they need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dyadica.session import group_rows, shuffle_partitions

PACKED = "target int, kind int, rows binary"
# A task holds up to this many rows or bytes before it packs them.
PACK_ROWS, PACK_BYTES = 1 << 20, 1 << 26
# Columns of up to this many values are packed as codes.
MOST_CODES = 127
# A task takes at least so many pairs, since each task packs some for every other.
LEAST_PAIRS = 1 << 18
# Rows handed on at once.
OUT_ROWS = 1 << 16
_MARKS = b"marks"


def _small(numbers: np.ndarray) -> pa.Array:
    """Whole numbers from 0 on in as few bytes as they need."""
    return pa.array(numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))))


def _encoded(column: pa.Array) -> tuple[pa.Array, str]:
    """A column in fewer bytes, and a mark that tells how to undo it."""
    kind = column.type
    if pa.types.is_int64(kind) and not column.null_count and len(column):
        numbers = column.to_numpy()
        least = int(numbers.min())
        if int(numbers.max()) - least < 1 << 32:
            return _small(numbers - least), f"+{least}"
    elif pa.types.is_float64(kind) or pa.types.is_string(kind):
        # A look at the first rows keeps columns of many values from being coded for nothing.
        if pc.count_distinct(column[: 4 * MOST_CODES], mode="all").as_py() <= MOST_CODES:
            coded = column.dictionary_encode()
            if len(coded.dictionary) <= MOST_CODES:
                return pa.DictionaryArray.from_arrays(coded.indices.cast(pa.int8()), coded.dictionary), "codes"
    elif pa.types.is_list(kind) and not column.null_count and len(column):
        sizes = pc.list_value_length(column).to_numpy()
        if sizes.min() == sizes.max() > 0:
            inner, mark = _encoded(column.flatten())
            return pa.FixedSizeListArray.from_arrays(inner, int(sizes[0])), f"lists {mark}"
    return column, ""


def _decoded(column: pa.Array, kind: pa.DataType, mark: str) -> pa.Array:
    if mark == "codes":
        return column.dictionary_decode()
    if mark.startswith("lists "):
        offsets = np.arange(0, (len(column) + 1) * column.type.list_size, column.type.list_size, dtype=np.int32)
        inner = _decoded(column.flatten(), kind.value_type, mark[len("lists "):])
        return pa.ListArray.from_arrays(pa.array(offsets), inner, type=kind)
    if mark[:1] in ("+", "^"):
        numbers = column.to_numpy().astype(np.int64)
        return pa.array((np.cumsum(numbers) if mark[0] == "^" else numbers) + int(mark[1:]))
    return column


def dump(table: pa.Table, key: str, order: np.ndarray, cuts: Sequence[int]) -> Iterator[bytes]:
    """The rows of ``table`` in ``order``, which sorts them by ``key``, cut at ``cuts``: one packed
    batch for each piece. Of the key itself the steps are kept."""
    taken = table.take(pa.array(order)).combine_chunks().to_batches()[0]
    at = taken.schema.get_field_index(key)
    columns, marks = (list(c) for c in zip(*(_encoded(c) for c in taken.columns)))
    keys = taken.column(at).to_numpy()
    steps = np.diff(keys, prepend=keys[:1])
    steps[cuts[:-1]] = 0
    columns[at] = _small(steps)
    schema = pa.schema([pa.field(f.name, c.type) for f, c in zip(taken.schema, columns)])
    batch = pa.RecordBatch.from_arrays(columns, schema=schema)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for first, last in zip(cuts[:-1], cuts[1:]):
        marks[at] = f"^{keys[first]}"
        marked = schema.with_metadata({_MARKS: ",".join(marks).encode()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, marked, options=options) as out:
            out.write_batch(batch.slice(first, last - first).replace_schema_metadata(marked.metadata))
        yield sink.getvalue().to_pybytes()


def load(rows: bytes, schema: pa.Schema) -> pa.RecordBatch:
    reader = pa.ipc.open_stream(rows)
    marks = reader.schema.metadata[_MARKS].decode().split(",")
    batch = reader.read_next_batch()
    columns = [_decoded(c, f.type, mark) for c, f, mark in zip(batch.columns, schema, marks)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def pack(batches, key: str, width: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Packed rows for targets 0, 1, ...: each takes the rows of the next ``width`` numbers in ``key``."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield from _pack_held(held, key, width, kind)
            held, rows, size = [], 0, 0
    if held:
        yield from _pack_held(held, key, width, kind)


def _pack_held(held: list, key: str, width: int, kind: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    keys = table.column(key).to_numpy()
    order = np.argsort(keys, kind="stable")
    targets, starts = np.unique(keys[order] // width, return_index=True)
    cuts = [*starts.tolist(), len(order)]
    for to, rows in zip(targets.tolist(), dump(table, key, order, cuts)):
        yield pa.RecordBatch.from_pydict(
            {"target": pa.array([to], pa.int32()), "kind": pa.array([kind], pa.int32()), "rows": pa.array([rows], pa.binary())}
        )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def packable(schema: T.StructType) -> bool:
    """Whether all columns have types that packing keeps as they are."""
    plain = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.BooleanType, T.StringType)
    return all(
        type(f.dataType) in plain or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType))
        for f in schema
    )


def _meet(batches, pairs: pa.Schema, values: pa.Schema, end: str, prefix: str, lose: bool):
    """Pairs with the values of one end, from packed rows sorted by target and kind, values first."""
    names = [*pairs.names, *(f"{prefix}_{c}" for c in values.names[1:])]
    at, held, table, sids = None, [], None, None
    out, waiting = [], 0
    for batch in batches:
        for target, kind, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if target != at:
                at, held, table = target, [], None
            if kind == 0:
                held.append(load(rows, values))
                continue
            if table is None:
                table = pa.Table.from_batches(held, schema=values)
                order = np.argsort(table.column("sid").to_numpy(), kind="stable")
                table = table.take(pa.array(order)).combine_chunks()
                sids, held = table.column("sid").to_numpy(), []
            met = load(rows, pairs)
            wanted = met.column(pairs.get_field_index(end)).to_numpy()
            place = np.searchsorted(sids, wanted)
            there = place < len(sids)
            there[there] = sids[place[there]] == wanted[there]
            if lose and not there.all():
                met, place, there = met.filter(pa.array(there)), place[there], there[there]
            found = table.take(pa.array(place, mask=~there))
            columns = [pa.chunked_array([c]) for c in met.columns] + found.columns[1:]
            if not lose:
                columns[pairs.get_field_index(end)] = found.column("sid")
            out.append(pa.Table.from_arrays(columns, names=names))
            waiting += met.num_rows
            if waiting >= OUT_ROWS:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, waiting = [], 0
    if waiting:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def packed_parts(spark: SparkSession, n: int, n_pairs: int) -> int:
    """Into how many stretches of 0..n-1 the pairs are dealt: a task takes no more than a group of them,
    and no fewer than LEAST_PAIRS where that leaves fewer stretches than Spark would make."""
    most = -(-n_pairs // max(1, group_rows(spark)))
    return max(1, min(n, max(most, min(shuffle_partitions(spark), n_pairs // LEAST_PAIRS))))


def gather_packed(pairs: DataFrame, values: DataFrame, n: int, parts: int) -> DataFrame:
    """``gather_by_shuffle`` with packed rows, where the values have the positions 0..n-1 in ``sid``:
    both shuffles deal the pairs, and the values, into ``parts`` stretches of positions.
    """
    width = max(1, -(-n // parts))
    values = values.select("sid", *[c for c in values.columns if c != "sid"])
    payload = values.schema.fields[1:]
    ends = ["i", "j"]
    pairs = pairs.select(*[c for c in pairs.columns if c not in ends], *ends)
    side = {s: [T.StructField(f"{s}_{f.name}", f.dataType) for f in payload] for s in "ab"}
    first, given = _arrow_schema(pairs.schema), _arrow_schema(values.schema)
    one = T.StructType([*pairs.schema.fields, *side["a"]])
    both = T.StructType([*one.fields, *side["b"]])
    second = _arrow_schema(one)

    def dealt(rows: DataFrame) -> DataFrame:
        packed = values.mapInArrow(lambda batches: pack(batches, "sid", width, 0), PACKED)
        every = packed.unionByName(rows).repartitionById(parts, F.col("target"))
        return every.sortWithinPartitions("target", "kind")

    drawn = dealt(pairs.mapInArrow(lambda batches: pack(batches, "i", width, 1), PACKED))
    met = dealt(
        drawn.mapInArrow(lambda batches: pack(_meet(batches, first, given, "i", "a", True), "j", width, 1), PACKED)
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in both])
    return met.mapInArrow(lambda batches: _meet(batches, second, given, "j", "b", False), schema)
