"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments of about log2(number of codes) bits, and each code is listed under each of its
segments' values. A search looks up, in rounds r = 0, 1, ..., the values at distance r from the query's segment. A code
at distance d has a segment at distance d / segments or less; so after round r all codes within segments * (r + 1) - 1
are known, and a query is finished when the distance of its k-th verified code is not above that. A round that would look
up about as many values as there are codes compares all codes instead.

Codes are dealt into chunks and queries into groups. A task lists one chunk in flat arrays and searches it for one group;
what leaves it is the k + 1 best ids of each query, so candidates are neither shuffled nor written. Chunks are large, as a
query's results are sent once for each, and few groups read a chunk, as its codes are sent once for each.

Equal codes are one entry with the k + 1 smallest ids, and equal queries are searched once, so a code that a third of the
rows share costs no more than another. Nothing but counts reaches the driver.

Cases: rows without id, or without a vector of 64 numbers, are left out; a missing number counts as not positive; equal distances go by the smaller id; a
row is not its own neighbour, rows that repeat an id are one; fewer than k others give fewer neighbours; further columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.shared import stored

BITS = 64
K = 10
#: Codes of a chunk, and queries that search it in one task.
CHUNK_CODES, GROUP_QUERIES = 1 << 20, 1 << 17
#: A chunk's codes are sent to so many groups at most for the sake of more tasks, and a group has so many queries at least.
MOST_GROUPS, LEAST_QUERIES = 8, 256
#: Rows that a step of a search compares at once.
STEP = 1 << 18
#: Queries that are searched together.
TOGETHER = 512
#: A looked up value or candidate costs as much as so many comparisons of neighbouring codes.
LOOKUP = 7


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, code): bit i is set if number i is positive."""
    number = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(
        F.get(embedding, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return (vectors.filter(F.col(vec_id).isNotNull() & (F.size(embedding) == BITS))
            .select(F.col(vec_id).cast("long").alias("id"), number.alias("code")))


def _segments(n_codes: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    count = math.ceil(BITS / min(max(round(math.log2(max(n_codes, 2))), 8), 22))
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class _Chunk:
    """Distinct codes with their ids, listed by the values of their segments."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.codes, self.ids, self.bounds, self.segments = codes, ids, bounds, _segments(len(codes))
        self.listed = []
        for shift, width in self.segments:
            value = _values(codes, shift, width)
            order = np.argsort(value, kind="stable").astype(np.int32)
            self.listed.append((order, codes[order], np.append(0, np.cumsum(np.bincount(value, minlength=1 << width))).astype(np.int32)))

    def cheap(self, radius: int) -> bool:
        """Whether looking up the values of a round beats comparing all codes."""
        each = sum(math.comb(width, radius) * (1 + len(self.codes) / (1 << width)) for _, width in self.segments)
        return LOOKUP * each < len(self.codes)

    def looked_up(self, queries: np.ndarray, at: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries, and in the list of segment ``at`` those of the codes that differ there in ``radius`` bits."""
        (shift, width), heads = self.segments[at], self.listed[at][2]
        change = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
        own, step = _values(queries, shift, width), max(STEP // max(len(change), 1), 1)
        for low in range(0, len(queries) if len(change) else 0, step):
            values = own[low:low + step, None] ^ change
            start, size = heads[values], heads[values + 1] - heads[values]
            upto, first = np.cumsum(size.sum(axis=1)), 0
            while first < len(upto):  # as many queries as have few candidates
                done = int(upto[first - 1]) if first else 0
                last = max(int(np.searchsorted(upto, done + STEP, "right")), first + 1)
                n, ends = size[first:last].ravel(), np.cumsum(size[first:last], dtype=np.int32)
                place = np.repeat(start[first:last].ravel() - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)
                yield np.repeat(np.arange(low + first, low + last), np.diff(upto[first:last], prepend=done)), place
                first = last

    def is_new(self, x: np.ndarray, at: int, radius: int) -> np.ndarray:
        """Whether codes that differ from the query by ``x`` were met neither in an earlier round nor under an earlier segment."""
        new = np.ones(len(x), bool)
        for i, (shift, width) in enumerate(self.segments):
            if i != at:
                new &= np.bitwise_count(_values(x, shift, width)) >= radius + (i < at)
        return new


def _values(codes: np.ndarray, shift: int, width: int) -> np.ndarray:
    return ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)


class _Best:
    """The ``most`` smallest (distance, id) of each of ``n`` queries, and perhaps some more."""

    def __init__(self, n: int, most: int) -> None:
        self.n, self.most = n, most
        self.kth = np.full(n, BITS, np.uint8)  # nothing above this distance is wanted
        self.full = np.zeros(n, bool)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)]  # query, distance, id

    def add(self, chunk: _Chunk, query: np.ndarray, code: np.ndarray, distance: np.ndarray) -> None:
        n = chunk.bounds[code + 1] - chunk.bounds[code]
        place = np.repeat(chunk.bounds[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.rows = [np.concatenate(two) for two in zip(self.rows, (np.repeat(query, n), np.repeat(distance, n), chunk.ids[place]))]
        upto = np.bincount(self.rows[0] * (BITS + 1) + self.rows[1], minlength=self.n * (BITS + 1)).reshape(self.n, -1).cumsum(axis=1)
        self.full = upto[:, -1] >= self.most
        self.kth = np.where(self.full, np.minimum((upto >= self.most).argmax(axis=1), self.kth), self.kth).astype(np.uint8)
        self.keep(self.rows[1] <= self.kth[self.rows[0]])
        if len(self.rows[0]) > 4 * self.n * self.most:  # very many at the last distance
            self.cut()

    def keep(self, which: np.ndarray) -> None:
        self.rows = [r[which] for r in self.rows]

    def cut(self) -> None:
        """Exactly the smallest, in order."""
        self.keep(np.lexsort(self.rows[::-1]))
        query = self.rows[0]
        self.keep(np.arange(len(query)) - np.searchsorted(query, query) < self.most)


def _searched(chunk: _Chunk, queries: np.ndarray, most: int) -> list[np.ndarray]:
    """query, distance, id: the ``most`` smallest (distance, id) of each query, by its place."""
    best, active = _Best(len(queries), most), np.arange(len(queries))
    for radius in range(max(width for _, width in chunk.segments) + 1):
        if not len(active) or not chunk.cheap(radius):
            break
        for at in range(len(chunk.segments)):
            order, codes, _ = chunk.listed[at]
            own = queries[active]
            for query, place in chunk.looked_up(own, at, radius):
                x = codes[place] ^ own[query]
                distance = np.bitwise_count(x)
                near = np.flatnonzero(distance <= best.kth[active][query])
                near = near[chunk.is_new(x[near], at, radius)]
                best.add(chunk, active[query[near]], order[place[near]], distance[near].astype(np.int64))
        covered = len(chunk.segments) * (radius + 1) - 1
        active = active[~best.full[active] | (best.kth[active] > covered)]
    if len(active):
        best.keep(~np.isin(best.rows[0], active))  # all their codes are compared, those met before again
        own, step = queries[active][:, None], max(STEP // len(active), 1)
        for low in range(0, len(chunk.codes), step):
            distance = np.bitwise_count(own ^ chunk.codes[low:low + step])
            query, code = np.nonzero(distance <= best.kth[active][:, None])
            best.add(chunk, active[query], code + low, distance[query, code].astype(np.int64))
    best.cut()
    return best.rows


def _search(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lists, asked = [], [], []
        for b in batches:
            wanted = np.asarray(b.column("ids").is_null())
            code = b.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
            asked.append(code[wanted])
            codes.append(code[~wanted])
            lists.append(b.column("ids").drop_null())
        codes, asked = np.concatenate(codes), np.concatenate(asked)
        if not len(codes):
            return
        sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists])
        ids = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])
        chunk = _Chunk(codes, ids, np.append(0, np.cumsum(sizes, dtype=np.int64)))
        for low in range(0, len(asked), TOGETHER):
            part = asked[low:low + TOGETHER]
            query, distance, near = _searched(chunk, part, most)
            bounds = pa.array(np.searchsorted(query, np.arange(len(part) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "query": part.view(np.int64), "distances": pa.ListArray.from_arrays(bounds, pa.array(distance.astype(np.int8))),
                "ids": pa.ListArray.from_arrays(bounds, pa.array(near))})

    return run


def _keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that Spark deals to ``n`` partitions, one to each."""
    part = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(40 * n).select(F.col("id").cast("int")).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    return ([r.id for r in found] + [-1 - i for i in range(n)])[:n]


def nearest(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the ``k`` nearest of ``codes`` (id, code) for each of ``queries`` (id, code)."""
    spark, by_code = codes.sparkSession, Window.partitionBy("code").orderBy("id")
    few = codes.distinct().withColumn("rn", F.row_number().over(by_code)).filter(F.col("rn") <= k + 1)
    entries = stored(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = stored(queries.distinct(), "queries")
    wanted = stored(asked.select("code").distinct(), "wanted")
    n_wanted, tasks = wanted.count(), spark.sparkContext.defaultParallelism
    chunks = max(math.ceil(entries.count() / CHUNK_CODES), 1)
    groups = max(math.ceil(n_wanted / GROUP_QUERIES), min(math.ceil(tasks / chunks), MOST_GROUPS, n_wanted // LEAST_QUERIES), 1)
    cell = lambda chunk, group: F.get(F.lit(_keys(spark, chunks * groups)), chunk * F.lit(groups) + group).alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunk, group = (F.pmod(F.xxhash64("code", F.lit(seed)), F.lit(n)).cast("int") for seed, n in enumerate((chunks, groups)))
    listed = entries.select("code", "ids", chunk.alias("chunk"), every(groups).alias("group"))
    searching = wanted.select("code", F.lit(None).cast("array<long>").alias("ids"), every(chunks).alias("chunk"), group.alias("group"))
    cells = listed.unionByName(searching).select(cell(F.col("chunk"), F.col("group")), "code", "ids").repartition(chunks * groups, "cell")
    found = stored(cells.groupBy("cell").applyInArrow(_search(k + 1), "query long, distances array<tinyint>, ids array<long>"), "found")
    each = F.arrays_zip(F.col("distances").alias("distance"), F.col("ids").alias("neighbour_id"))
    lists = found.repartition("query").groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list(each))), 1, k + 1).alias("list"))
    own = asked.join(lists, asked["code"] == lists["query"]).select(F.col("id").alias("query_id"), F.slice(
        F.filter("list", lambda x: x["neighbour_id"] != F.col("id")), 1, k).alias("list"))
    return own.select("query_id", F.posexplode("list").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.neighbour_id", F.col("x.distance").cast("int").alias("distance"))
