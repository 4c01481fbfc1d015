"""Exact k-means over dictionaries of subvectors.

Vectors of whole numbers are cut into blocks of dimensions. In each chunk of vectors a block is encoded losslessly: its
distinct subvectors are listed once, each vector keeps the code of its own. Blocks are as wide as pays: neighbouring ones
are joined while the list of the joined one is smaller than the codes that it saves, so that one dimension of few values,
or a whole vector that very many rows share, is one entry. In a round, the exact squared distances from each listed
subvector to the centroids' part of that block are computed once; a vector's distances are the sums of its codes' entries.
Sums for the new centroids are taken by code as well: how often each code fell to each centroid, times the subvectors.

The encoded chunks are written once and read in every round, without a shuffle but for ``k`` rows of sums from each task.
Only these sums (``k`` times the number of dimensions) and the ``k`` first vectors reach the driver.

Cases: vectors that are null, of another length, or hold a null, infinity or NaN are left out, and so are not in the
result; a row without id is clustered, but is no first centroid; rows that repeat an id are vectors of their own, and
if all of them are among the first, equal ones give equal centroids, the smaller number of which gets all; fewer than ``k``
vectors with ids give fewer centroids; no vectors or no ids give no rows; a component above 131,072 stops the
job (distances would leave 64 bits); further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.vectors import (chunk_table, chunks, floor_means, int_column, joined_numbers, lists, seeds, squared, usable,
                                whole_numbers)

DIMS = 64
K = 8
ROUNDS = 10
_CHUNK = "ids array<long>, widths binary, sizes binary, entries binary, codes binary"
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a block of one dimension, and the code of each row."""
    values, codes = np.unique(block, return_inverse=True)
    return values.reshape(-1, 1), codes.ravel()


def blocks(numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct subvectors, codes) of consecutive blocks that together are the whole vectors."""
    found = [dictionary(numbers[:, d]) for d in range(numbers.shape[1])]
    open_ = [True] * len(found)
    while True:
        merged, still, at, any_ = [], [], 0, False
        while at < len(found):
            pair = None
            if at + 1 < len(found) and open_[at] and open_[at + 1] and found[at][0].shape[1] == found[at + 1][0].shape[1]:
                (a, x), (b, y) = found[at], found[at + 1]
                both, codes = np.unique(x * len(b) + y, return_inverse=True)
                entries = np.hstack([a[both // len(b)], b[both % len(b)]])
                pair = (entries, codes.ravel()) if entries.size <= len(x) + a.size + b.size else None
            if pair is not None:
                merged.append(pair)
                still.append(True)
                any_, at = True, at + 2
            else:
                merged.append(found[at])
                still.append(False)
                at += 1
        found, open_ = merged, still
        if not any_:
            return found


def encoded(vectors: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    """One row for each chunk: ids, width and number of entries of each block, all entries, all codes block by block."""

    def run(batches):
        for chunk in chunks(batches):
            found = blocks(whole_numbers(chunk.column(1), dims))
            yield pa.RecordBatch.from_pydict({
                "ids": lists(chunk.column(0)),
                "widths": [np.array([e.shape[1] for e, _ in found], np.int32).tobytes()],
                "sizes": [np.array([len(e) for e, _ in found], np.int32).tobytes()],
                "entries": [np.concatenate([e.ravel() for e, _ in found]).astype(np.int32).tobytes()],
                "codes": [np.concatenate([c for _, c in found]).astype(np.uint16).tobytes()]})

    return vectors.select(F.col(vec_id).cast("long"), embedding).mapInArrow(run, _CHUNK)


def decoded(batch: pa.RecordBatch, row: int) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids and blocks of a chunk."""
    ids = batch.column("ids")[row].values
    widths, sizes, entries = (np.frombuffer(batch.column(c)[row].as_py(), np.int32) for c in ("widths", "sizes", "entries"))
    codes = np.frombuffer(batch.column("codes")[row].as_py(), np.uint16).reshape(len(widths), len(ids))
    ends = np.cumsum(widths.astype(np.int64) * sizes)
    return ids, [(entries[end - w * n:end].reshape(n, w).astype(np.int64), own) for w, n, end, own in
                 zip(widths.tolist(), sizes.tolist(), ends.tolist(), codes)]


def nearest(found: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector of a chunk; the smaller number of equally near ones."""
    total, at = np.zeros((len(found[0][1]), len(centroids)), np.int64), 0
    for entries, codes in found:
        parts = squared(entries, centroids[:, at:at + entries.shape[1]])
        total += parts[codes]
        at += entries.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def gathered(found: list[tuple[np.ndarray, np.ndarray]], cluster: np.ndarray, k: int) -> np.ndarray:
    """Sum of the vectors of each cluster."""
    sums = []
    for entries, codes in found:
        times = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
        sums.append(times @ entries)
    return np.hstack(sums)


def _totals(chunk_rows: DataFrame, centroids: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, inertia and sum of vectors of each cluster."""
    k = len(centroids)

    def run(batches):
        count, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                _, found = decoded(batch, row)
                cluster, distance = nearest(found, centroids)
                count += np.bincount(cluster, minlength=k)
                np.add.at(inertia, cluster, distance)
                sums += gathered(found, cluster, k)
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(k, dtype=np.int32), "n": count, "inertia": inertia, "sums": list(sums)})

    parts = chunk_rows.mapInArrow(run, "cluster int, n long, inertia long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(
        *[F.sum(F.col("sums")[d]) for d in range(dims)]).alias("sums")).collect()
    count, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in rows:
        count[r.cluster], inertia[r.cluster], sums[r.cluster] = r.n, r.inertia, r.sums
    return count, inertia, sums


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 3,
              vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each usable vector.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:id``.
    """
    kept = vectors.select(vec_id, embedding).filter(usable(embedding, dims))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("long").cast("string")), 256)
    centroids = seeds(kept.filter(F.col(vec_id).isNotNull()), [order], k, embedding, dims)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _RESULT)
    rows, _ = chunk_table(encoded(kept, vec_id, embedding, dims), "subvectors")
    for _ in range(rounds):
        count, _, sums = _totals(rows, centroids, dims)
        centroids = floor_means(count, sums, centroids)
    _, inertia, _ = _totals(rows, centroids, dims)
    names = [hashlib.sha256(joined_numbers(c).encode()).hexdigest() for c in centroids]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, found = decoded(batch, row)
                cluster, distance = nearest(found, centroids)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids, "cluster": int_column(cluster, pa.int32()), "distance": distance,
                    "cluster_inertia": inertia[cluster], "inertia": np.full(len(cluster), inertia.sum()),
                    "centroid_sha256": pa.array(names).take(pa.array(cluster))})

    return rows.mapInArrow(run, _RESULT)
