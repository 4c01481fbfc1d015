"""Token ids packed into rows of equal length.

Texts are encoded with the end-of-text id after each, and texts longer than a row are split without loss: full rows first,
the rest is packed. Packing is best-fit decreasing: segments by falling length, each into the row that has the least
room left among those with enough. Rows are found by their free room with a segment tree over the room sizes, so a
search takes log(row length) steps however many rows are open.

Each task packs what it reads, at most ``PACK_BYTES`` of text at a time, so nothing is shuffled, memory is bounded, and a lost
task is done again with the same result. What packs in pieces costs is at most the last, part-filled rows of each piece.

A row of the result: shard and row number, ids (little-endian unsigned 32-bit integers, padded to the row's length),
cumulative segment lengths, positions (32-bit integers that start from 0 in each segment; padding has 0), and for each
segment the document and the token of it at which the segment starts.

Cases: a null or empty text is a segment of the end id alone; repeated rows are packed each; an empty table gives no
rows; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.bpe import transducer, vocabulary_path
from fathom.llm.shared import pieces

ROW = 2048
PACK_BYTES = 16 << 20


class RoomTree:
    """Segment tree over room sizes 0..limit: how many open rows have each room."""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Row with the smallest room that is at least ``least``, and that room."""
        node, count = least + self.width, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.width
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """Row of each segment, and the number of rows."""
    tree, rows = RoomTree(limit), 0
    out = np.empty(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = tree.take(n) if n < limit else None
        row, room = found or (rows, limit)
        rows += found is None
        out[k] = row
        if room > n:
            tree.put(room - n, row)
    return out, rows


def packed(docs: DataFrame, path: str | None = None, row_length: int = ROW, end_id: int = 50256) -> DataFrame:
    """shard, row, ids, cumulative (segment bounds), positions, doc_ids, starts, n_tokens."""

    def pack(ids: np.ndarray, offsets: np.ndarray, doc_ids: pa.Array, shard: int) -> pa.RecordBatch:
        m = len(offsets) - 1
        sizes = np.diff(offsets) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        stream = np.full(bounds[-1], end_id, np.uint32)
        stream[np.arange(len(ids)) + np.repeat(np.arange(m), np.diff(offsets))] = ids
        cuts = -(-sizes // row_length)
        doc = np.repeat(np.arange(m), cuts)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * row_length
        length = np.minimum(sizes[doc] - start, row_length)
        row, rows = best_fit(length, row_length)
        order = np.lexsort((start, doc, row))
        row, doc, start, length = row[order], doc[order], start[order], length[order]
        first = np.searchsorted(row, np.arange(rows + 1))
        before = np.cumsum(length) - length
        inside = before - np.repeat(before[first[:-1]], np.diff(first))
        place = np.arange(int(length.sum())) - np.repeat(before, length)
        target = np.repeat(row * row_length + inside, length) + place
        matrix, positions = np.full(rows * row_length, end_id, "<u4"), np.zeros(rows * row_length, "<i4")
        matrix[target] = stream[np.repeat(bounds[doc] + start, length) + place]
        positions[target] = place
        lists = lambda values: pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)
        ends = np.insert(inside + length, first[:-1], 0)
        blob = lambda x: pa.array([r.tobytes() for r in x.reshape(rows, row_length)], pa.binary())
        return pa.RecordBatch.from_pydict({
            "shard": pa.array(np.full(rows, shard), pa.int64()), "row": pa.array(np.arange(rows), pa.int64()), "ids": blob(matrix),
            "cumulative": pa.ListArray.from_arrays(pa.array(first + np.arange(rows + 1), pa.int32()), pa.array(ends, pa.int32())),
            "positions": blob(positions), "doc_ids": lists(doc_ids.take(pa.array(doc))),
            "starts": lists(pa.array(start, pa.int64())), "n_tokens": pa.array(np.add.reduceat(length, first[:-1]), pa.int64())})

    def run(batches):
        known = transducer(path or vocabulary_path())
        shard = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            ids, offsets = zip(*[known.encode(piece.column("text")) for piece in held])
            shifts = np.cumsum([0, *map(len, ids)])
            joined = np.concatenate([[0], *(o[1:] + s for o, s in zip(offsets, shifts))])
            return pack(np.concatenate(ids), joined, pa.concat_arrays([p.column("doc_id") for p in held]), shard)

        for piece in pieces(batches):
            held.append(piece)
            size += piece.nbytes
            if size >= PACK_BYTES:
                yield flush()
                held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(run, "shard long, row long, ids binary, cumulative array<int>, positions binary, "
                                 "doc_ids array<long>, starts array<long>, n_tokens long")


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed rows as a Parquet table: one binary value is one row of the id matrix."""
    packed(docs, **options).write.parquet(path)
