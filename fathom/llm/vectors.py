"""Vectors of whole numbers, kept in chunks: one row of a chunk table holds some ten thousand vectors of one task.

Chunk tables lie uncompressed in the shared checkpoint folder, so that a split of a given size is that much memory too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.plans.lineage import checkpoint_folder

#: A component x stands for floor(SCALE * x).
SCALE = 1024
#: Vectors of a chunk. Codes within a chunk fit 16 bits.
CHUNK = 1 << 15
#: Above this, squared distances and their sums would leave 64 bits.
LARGEST = 1 << 27
#: Up to this, products of two vectors are exact in floating point.
EXACT = 1 << 20


def usable(embedding: str, dims: int) -> Column:
    """The vector has ``dims`` components, none null, infinite or not a number."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dims) & finite, F.lit(False))


def whole_numbers(vectors: pa.Array, dims: int) -> np.ndarray:
    """Matrix of floor(SCALE * x); all vectors must be usable."""
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    values = np.floor(SCALE * values)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"a vector has a component above {LARGEST // SCALE}: its distances would not fit 64 bits")
    return values.astype(np.int32)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Joins record batches until they have ``size`` rows; the last may have fewer."""
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - rows)
            at, rows = at + part.num_rows, rows + part.num_rows
            held.append(part)
            if rows == size:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def lists(column: pa.Array) -> pa.Array:
    """A chunk's column as one list."""
    offsets = pa.array([0, len(column)], pa.int32())
    return pa.ListArray.from_arrays(offsets, column)


def exact(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in the type in which their products are exact and quickest."""
    small = not numbers.size or np.abs(numbers).max() < EXACT
    return numbers.astype(np.float64 if small else np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` from all of ``y``, both whole numbers."""
    x, y = (exact(x), exact(y))
    if x.dtype != y.dtype:
        x, y = x.astype(np.int64), y.astype(np.int64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)


def floor_means(counts: np.ndarray, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each row; rows of nothing stay as they were."""
    return np.where(counts[:, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, None]), before)


def seeds(vectors: DataFrame, order: list[Column], n: int, embedding: str, dims: int) -> np.ndarray:
    """The first ``n`` vectors by ``order``, then by their components."""
    first = vectors.orderBy(*order, embedding).limit(n).select(embedding).collect()
    return whole_numbers(pa.array([r[0] for r in first], pa.list_(pa.float64())), dims).astype(np.int64)


def chunk_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared checkpoint folder; the table and its path."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a chunk table that a newer one replaces."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def joined_numbers(numbers: np.ndarray) -> str:
    return ",".join(map(str, numbers.ravel().tolist()))


def int_column(values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pc.cast(pa.array(values), kind)
