"""Rows on their way through a shuffle as packed pieces, a binary each, instead of one by one.

A posting as a row repeats its document, field and length and has eight bytes for each number; packed, a piece names each
term and document once and has its numbers as differences in as few bytes as they need, compressed. A task packs the rows
it has, so nothing depends on their order; those of one term next to each other, as a task of the analysis has them, pack best.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of rows that a task packs at once, and rows that it hands on at once.
PACK_BYTES, HAND_ROWS = 48 << 20, 1 << 14
_KINDS = ("u1", "i1", "u2", "i2", "u4", "i4", "i8")
_ZSTD = "zstd"


def _numbers_in(a: np.ndarray) -> tuple[str, int, bytes]:
    """Whole numbers in the smallest type that holds them, their first bytes together, then their second, and so on."""
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    kind = next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    planes = a.astype(kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T
    return kind, len(a), pa.compress(np.ascontiguousarray(planes).tobytes(), _ZSTD, asbytes=True)


def _numbers_out(packed: tuple[str, int, bytes]) -> np.ndarray:
    kind, n, data = packed
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, _ZSTD, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def _arrow_in(column: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays([column], ["c"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _arrow_out(data: bytes) -> pa.Array:
    column = pa.ipc.open_stream(data).read_all().column(0)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _words_in(words: pa.Array) -> tuple:
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8) if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if words.buffers()[2] is not None else b""
    return _numbers_in(np.diff(bounds)), len(data), pa.compress(data, _ZSTD, asbytes=True)


def _words_out(packed: tuple) -> pa.Array:
    sizes, size, data = packed
    bounds = np.append(0, np.cumsum(_numbers_out(sizes)))
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(pa.decompress(data, size, _ZSTD, asbytes=True)))


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in order, and the place of each row's word."""
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)]


def _steps(a: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Differences, but for the numbers at ``heads``, which stay."""
    out = np.diff(a, prepend=0)
    out[heads] = a[heads]
    return out


def _summed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Back from :func:`_steps` over stretches of these sizes."""
    upto = np.append(0, np.cumsum(steps))
    return upto[1:] - np.repeat(upto[np.cumsum(sizes) - sizes], sizes)


def _column_in(column: pa.Array) -> tuple:
    kind = column.type
    if column.null_count or pa.types.is_list(kind) and (column.flatten().null_count or not pa.types.is_integer(kind.value_type)):
        return "arrow", _arrow_in(column)
    if pa.types.is_integer(kind):
        return "numbers", _numbers_in(column.to_numpy(zero_copy_only=False))
    if pa.types.is_list(kind):
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        heads = (np.cumsum(sizes) - sizes)[sizes > 0]
        return "lists", _numbers_in(sizes), _numbers_in(_steps(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), heads))
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        words, code = _coded(column)
        return "words", _words_in(words), _numbers_in(np.diff(code, prepend=0))
    return "arrow", _arrow_in(column)


def _column_out(packed: tuple, kind: pa.DataType) -> pa.Array:
    how, *rest = packed
    if how == "arrow":
        return _arrow_out(rest[0])
    if how == "numbers":
        return pa.array(_numbers_out(rest[0])).cast(kind)
    if how == "lists":
        sizes = _numbers_out(rest[0])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)),
                                        pa.array(_summed(_numbers_out(rest[1]), sizes)).cast(kind.value_type)).cast(kind)
    return _words_out(rest[0]).take(pa.array(np.cumsum(_numbers_out(rest[1])))).cast(kind)


def _piece(rows: pa.Table) -> bytes:
    """Documents and their lengths are named once as pairs; ``end`` is told by its distance from ``start``."""
    columns = {name: rows.column(name).combine_chunks() for name in rows.column_names}
    out = {}
    if {"doc", "field_len"} <= set(columns) and pa.types.is_string(columns["doc"].type) and not any(columns[c].null_count for c in ("doc", "field_len")):
        (docs, of), length = _coded(columns.pop("doc")), columns.pop("field_len").to_numpy(zero_copy_only=False).astype(np.int64)
        least = int(length.min(initial=0))
        width = int(length.max(initial=0)) - least + 1
        pairs, code = np.unique(of * width + length - least, return_inverse=True)
        out["__pairs"] = _words_in(docs), _numbers_in(pairs // width), _numbers_in(pairs % width + least), _numbers_in(code)
    if {"start", "end"} <= set(columns) and columns["start"].type == columns["end"].type:
        start, end = columns["start"], columns["end"]
        first, last = start.flatten(), end.flatten()
        if not (start.null_count or end.null_count or first.null_count or last.null_count) and pc.list_value_length(start).equals(pc.list_value_length(end)):
            del columns["end"]
            out["__sizes"] = _numbers_in(pc.subtract(last, first).to_numpy(zero_copy_only=False))
    return pickle.dumps(out | {name: _column_in(c) for name, c in columns.items()}, protocol=5)


def rows_of(piece: bytes, schema: pa.Schema) -> pa.RecordBatch:
    """The rows of a piece."""
    held, columns = pickle.loads(piece), {}
    if "__pairs" in held:
        docs, doc, length, code = held.pop("__pairs")
        doc, length, code = (_numbers_out(x) for x in (doc, length, code))
        columns["doc"] = _words_out(docs).take(pa.array(doc[code])).cast(schema.field("doc").type)
        columns["field_len"] = pa.array(length[code]).cast(schema.field("field_len").type)
    sizes = held.pop("__sizes", None)
    columns |= {name: _column_out(c, schema.field(name).type) for name, c in held.items()}
    if sizes is not None:
        start = columns["start"]
        columns["end"] = pa.ListArray.from_arrays(start.offsets, pa.array(start.flatten().to_numpy(zero_copy_only=False) + _numbers_out(sizes)).cast(
            schema.field("end").type.value_type)).cast(schema.field("end").type)
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def _order(rows: pa.Table, by: list[str]) -> np.ndarray:
    """By the keys; inside them by field, term and document."""
    keys = []
    for name in ("doc", "term", "field"):
        if name in rows.column_names:
            column = rows.column(name).combine_chunks()
            keys.append(_coded(column.cast(pa.string()).fill_null("") if column.null_count else column)[1])
    return np.lexsort(keys + [rows.column(k).to_numpy() for k in reversed(by)])


def pieces_of(rows: pa.Table, by: list[str]) -> pa.RecordBatch:
    """``by`` and ``piece``: the rows with these numbers."""
    rows = rows.take(pa.array(_order(rows, by)))
    keys = np.stack([rows.column(k).to_numpy() for k in by])
    heads = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    rest = rows.drop_columns(by)
    found = [_piece(rest.slice(a, b - a)) for a, b in zip(heads, np.append(heads[1:], len(rows)))]
    return pa.RecordBatch.from_pydict({k: pa.array(keys[i][heads], pa.int32()) for i, k in enumerate(by)} | {"piece": pa.array(found, pa.binary())})


def gathered(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield pieces_of(pa.Table.from_batches(held), by)
            held, size = [], 0
    if held:
        yield pieces_of(pa.Table.from_batches(held), by)


def handed_on(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, HAND_ROWS):
        yield batch.slice(low, HAND_ROWS)


def packed(df: DataFrame, by: list[str]) -> DataFrame:
    """``by`` (ints without nulls) and ``piece``: the rows of ``df`` in pieces of rows with equal ``by``."""
    return df.mapInArrow(lambda batches: gathered(batches, by), ", ".join([*(f"{k} int" for k in by), "piece binary"]))


def inner(schema: StructType, by: list[str]) -> pa.Schema:
    """The columns inside a piece."""
    return pa.schema([f for f in to_arrow_schema(schema) if f.name not in by])


def unpacked(df: DataFrame, by: list[str], schema: StructType) -> DataFrame:
    """The rows again, with the columns of ``schema``."""
    whole, own_rows = to_arrow_schema(schema), inner(schema, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = rows_of(batch.column("piece")[i].as_py(), own_rows)
                own = {k: pa.array(np.full(rows.num_rows, batch.column(k)[i].as_py(), np.int32)) for k in by}
                yield from handed_on(pa.RecordBatch.from_arrays([own[f.name] if f.name in own else rows.column(f.name) for f in whole], names=whole.names))

    return df.select(*by, "piece").mapInArrow(run, schema)


# ---- joins ----------------------------------------------------------------------------------------------------------------

#: Rows of a task of a join.
PART_ROWS = 4_000_000


def parts_for(spark: SparkSession, n_rows: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, math.ceil(n_rows / PART_ROWS))


def together(left: DataFrame, right: DataFrame, on: list[str], parts: int) -> DataFrame:
    """Pieces of both tables, dealt out by ``on``; in each partition those of ``right`` come before those of ``left``."""
    dealt = lambda df, kind: packed(df.withColumn("part", F.pmod(F.xxhash64(*on), F.lit(parts)).cast("int")), ["part"]).withColumn("kind", F.lit(kind))
    return dealt(left, 1).unionByName(dealt(right, 0)).repartition(parts, "part").sortWithinPartitions("part", "kind")


def met(batches: Iterator[pa.RecordBatch], left: pa.Schema, right: pa.Schema, on: list[str]) -> Iterator[pa.Table]:
    """The inner join of the pieces of :func:`together`, piece by piece; ``right`` has few rows for each part."""
    part, found, table = None, [], None
    for batch in batches:
        for i in range(batch.num_rows):
            if part != batch.column("part")[i].as_py():
                part, found, table = batch.column("part")[i].as_py(), [], None
            piece = batch.column("piece")[i].as_py()
            if not batch.column("kind")[i].as_py():
                found.append(rows_of(piece, right))
            elif found:
                table = table if table is not None else pa.Table.from_batches(found)
                yield pa.Table.from_batches([rows_of(piece, left)]).join(table, on, join_type="inner", use_threads=False)


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left.join(right, on)`` for a table ``right`` that has few rows for each of ``left``: a smaller one than Spark broadcasts
    is broadcast, else both are dealt out packed."""
    spark = left.sparkSession
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size(right) <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return left.join(right, on)
    schemas = to_arrow_schema(left.schema), to_arrow_schema(right.schema)
    schema = StructType([*[left.schema[c] for c in on], *[f for df in (left, right) for f in df.schema if f.name not in on]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in met(batches, *schemas, on):
            for batch in table.select(schema.fieldNames()).combine_chunks().to_batches():
                yield from handed_on(batch)

    return together(left, right, on, parts_for(spark, left.count())).mapInArrow(run, schema)
