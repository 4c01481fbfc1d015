"""Helpers of this subpackage: intermediate tables, and texts as flat arrays inside a task."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from fathom.plans.lineage import checkpoint_folder

#: Bytes of text that a task turns into flat arrays at once; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20

_BYTES = np.arange(256, dtype=np.uint8)
#: Lower-cases A-Z, keeps all else.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
#: Lower-cases A-Z; ASCII other than letters and digits becomes a space.
LETTERS = np.where((_BYTES >= 0x80) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)),
                   LOWER, 0x20).astype(np.uint8)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it: cuts lineage, survives lost executors."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of the tables has it; Spark does not look at case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len + 1 offsets. A null text is empty."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into pieces with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            upto = max(int(np.searchsorted(ends, base + limit, "right")), at + 1)
            yield batch.slice(at, upto - at)
            release()
            at, base = upto, int(ends[upto - 1])


def words(texts: pa.Array, translate: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Splits texts at ASCII white space after ``translate`` has been applied to each byte.

    Returns the code of each word, the distinct words, and the len + 1 offsets of the texts' words.
    """
    data, offsets = flat(texts)
    mapped = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)),
                                              pa.py_buffer(translate[data]))
    lists = pc.ascii_split_whitespace(mapped)
    flat_words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.binary_length(flat_words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        flat_words = flat_words.filter(pa.array(full))
    coded = pc.dictionary_encode(flat_words)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, bounds


def hashed(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each string, equal in every process."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser for sums of hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def release() -> None:
    """Gives memory that a finished step used back to the system; a worker lives on for many tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
