"""Shards of nearly equal bytes by best-fit-decreasing bin packing of indivisible groups.

A group is all documents with the same text, so copies never part. Groups are taken from large to small, and each enters
the open bin with the least room that still holds it, found in a balanced tree of the bins' room; a new bin is opened if
none does. That keeps the number of bins of a given capacity small; for a given number of shards, the smallest capacity
(to a thousandth) that needs no more bins is looked for. Groups above an even share get a shard of their own, and the
others share the rest evenly.

Packing is sequential, so it runs on two levels. Groups are dealt over ``PARTS`` parts by hash, and each part, sorted by
size and read as a stream, packs its groups into blocks of a small fixed capacity (``1 / BLOCKS`` of a shard); a task holds only
its open blocks' room. A group larger than that is a block of its own. Blocks number at most ``3 * shards * BLOCKS + PARTS``,
whatever the input (large groups, and blocks of which any two of a part exceed the capacity together); they are packed
into shards by the same method on the driver, and their places are broadcast.

Groups are sums by text digest, taken before the shuffle where copies meet. Slots inside a shard run over buckets of
documents (counted first, so that no shard is sorted by one task), in buckets by document and digest.

Cases: a null text has size 8 and is one group of its own, apart from the empty text, which has the same size; rows that repeat a document are
counted, and get a slot each; a row without id is placed by its text like any other; an empty table gives no rows; fewer
groups than shards leave shards empty; further columns are not looked at, and ``write_shards`` keeps them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.shared import stored

SHARDS = 24
#: Bytes of a document besides its text.
HEAD = 8
PARTS = 256
BLOCKS = 64
#: Documents of a bucket within which slots are counted.
BUCKET = 100_000


class Rooms:
    """Bins by room, as a balanced search tree (AVL) of (room, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _node(key, left, right):
        return key, left, right, 1 + max(left[3] if left else 0, right[3] if right else 0)

    def _balanced(self, key, left, right):
        high = lambda n: n[3] if n else 0
        if high(left) > high(right) + 1:
            if high(left[1]) >= high(left[2]):
                return self._node(left[0], left[1], self._node(key, left[2], right))
            middle = left[2]
            return self._node(middle[0], self._node(left[0], left[1], middle[1]), self._node(key, middle[2], right))
        if high(right) > high(left) + 1:
            if high(right[2]) >= high(right[1]):
                return self._node(right[0], self._node(key, left, right[1]), right[2])
            middle = right[1]
            return self._node(middle[0], self._node(key, left, middle[1]), self._node(right[0], middle[2], right[2]))
        return self._node(key, left, right)

    def _with(self, node, key):
        if node is None:
            return self._node(key, None, None)
        if key < node[0]:
            return self._balanced(node[0], self._with(node[1], key), node[2])
        return self._balanced(node[0], node[1], self._with(node[2], key))

    def _without(self, node, key):
        if key < node[0]:
            return self._balanced(node[0], self._without(node[1], key), node[2])
        if key > node[0]:
            return self._balanced(node[0], node[1], self._without(node[2], key))
        if node[1] is None or node[2] is None:
            return node[1] or node[2]
        least = node[2]
        while least[1]:
            least = least[1]
        return self._balanced(least[0], node[1], self._without(node[2], least[0]))

    def add(self, room: int, of: int) -> None:
        self.root = self._with(self.root, (room, of))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room of ``size`` at least, the lowest number of equal ones."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best:
            self.root = self._without(self.root, best)
        return best


class Bins:
    """Best fit into bins of one capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.count = capacity, Rooms(), 0

    def place(self, size: int, times: int) -> list[tuple[int, int]]:
        """Places ``times`` groups of ``size``: (bin, how many) in order. The tightest bin stays so until it is full."""
        out = []
        while times:
            found = self.rooms.take_tightest(size)
            room, of = found or (self.capacity, self.count)
            self.count += found is None
            here = min(times, room // size)
            out.append((of, here))
            times -= here
            if room > here * size:
                self.rooms.add(room - here * size, of)
        return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size. ``capacity`` holds the largest."""
    bins, out = Bins(capacity), [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for size, same in itertools.groupby(order, key=lambda i: sizes[i]):
        same = list(same)
        places = (of for of, n in bins.place(size, len(same)) for _ in range(n))
        for i, of in zip(same, places):
            out[i] = of
    return out


def shards_of(sizes: list[int], shards: int) -> list[int]:
    """Shard of each block: groups above an even share alone, the rest with the smallest capacity that needs no more shards."""
    out, order = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, alone = sum(sizes), 0
    while alone < min(len(order), shards - 1) and sizes[order[alone]] * (shards - alone) > left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest, n = order[alone:], shards - alone
    if not rest:
        return out
    own = [sizes[i] for i in rest]
    low = max(-(-left // n), own[0])  # no smaller capacity can do
    high = -(-left // n) + own[0]  # with this much, a bin beyond n would mean that n bins hold more than there is
    best = best_fit_decreasing(own, high)
    while high - low > max(left // n // 1000, 1):
        middle = (low + high) // 2
        tried = best_fit_decreasing(own, middle)
        if max(tried) < n:
            best, high = tried, middle
        else:
            low = middle
    for i, of in zip(rest, best):
        out[i] = alone + of
    return out


def _blocks(groups: DataFrame, capacity: int) -> DataFrame:
    """digest, part, block of each group of ``groups`` (digest, part, bytes)."""

    def run(batches):
        part, bins = None, None
        for batch in batches:
            parts, sizes = batch.column("part").to_numpy(), batch.column("bytes").to_numpy()
            edge = np.flatnonzero((np.diff(parts) != 0) | (np.diff(sizes) != 0)) + 1
            at, out = [0, *edge.tolist(), len(sizes)] if len(sizes) else [], np.zeros(len(sizes), np.int64)
            for low, high in zip(at, at[1:]):
                if parts[low] != part:
                    part, bins = parts[low], Bins(capacity)
                size = int(sizes[low])
                if size > capacity:  # a block alone
                    out[low:high] = np.arange(bins.count, bins.count + high - low)
                    bins.count += high - low
                else:
                    places = bins.place(size, high - low)
                    out[low:high] = np.repeat([of for of, _ in places], [n for _, n in places])
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "part": batch.column("part"),
                                              "bytes": batch.column("bytes"), "block": out})

    dealt = groups.repartition("part").sortWithinPartitions("part", F.desc("bytes"), "digest")
    return dealt.mapInArrow(run, "digest binary, part int, bytes long, block long")


def _digest(text: str) -> F.Column:
    """A null text has a digest of its own."""
    return F.unhex(F.coalesce(F.md5(text), F.lit("00")))


def _group_shards(texts: DataFrame, shards: int) -> DataFrame:
    """digest, shard for ``texts`` (digest, size)."""
    groups = stored(texts.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn(
        "part", F.pmod(F.xxhash64("digest"), F.lit(PARTS)).cast("int")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    placed = stored(_blocks(groups, max(total // (shards * BLOCKS), 1)), "blocks")
    blocks = placed.groupBy("part", "block").agg(F.sum("bytes").alias("bytes")).orderBy("part", "block").collect()
    into = shards_of([b.bytes for b in blocks], shards)
    places = texts.sparkSession.createDataFrame(
        [(b.part, b.block, s) for b, s in zip(blocks, into)], "part int, block long, shard int")
    return stored(placed.join(F.broadcast(places), ["part", "block"]).select(F.col("digest").alias("of"), "shard"), "shards")


def placements(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: only a law by key has one) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _digest(text).alias("digest"), (
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + HEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"))
    # Copies of a whole row are one row with a number of times.
    rows = stored(rows.groupBy("doc_id", "digest", "size", "text_crc32").agg(F.count("*").alias("times")), "rows")
    of = _group_shards(rows.select("digest", (F.col("size") * F.col("times")).alias("size")), shards)
    placed = stored(rows.join(of, rows["digest"] == of["of"]).drop("of"), "placed")
    # Slots: buckets of a shard one after the other, each sorted by itself.
    buckets = math.ceil(placed.count() / shards / BUCKET) or 1
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.sum("times").alias("n"))
    before = stored(counts.select("shard", "bucket", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before")), "offsets")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    first = placed.withColumn("first", F.sum("times").over(inside) - F.col("times")).join(before, ["shard", "bucket"])
    return first.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.explode(F.sequence(
        F.col("before") + F.col("first"), F.col("before") + F.col("first") + F.col("times") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, text: str = "text") -> None:
    """Writes the rows of ``docs``, all columns, into folders ``shard=0``, ``shard=1``, ... under ``folder``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, _digest(text).alias("digest"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + HEAD).alias("size"))
    of = _group_shards(rows.select("digest", "size"), shards)
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows.join(of, rows["digest"] == of["of"]).select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(folder)
