"""Benchmark decontamination by spaced seeds.

Fixed masks of ``SPAN`` words look at some positions and ignore the others, so a passage with a few substituted words still
shares hashes with its benchmark item. Hashes of both sides are joined; around each hit, the aligned words are compared and
the best stretch is kept in which at most one word in five differs. An item under ``SPAN`` words has a mask of its own length
that ignores nothing.

A bitmap of fixed size over the benchmark's hashes lets each task drop nearly all windows before the join; it holds for a
benchmark of any size, only less sharply. Only the surroundings of hits are shuffled. Items of the same words are compared
once.

Words are runs of letters and digits, A-Z lower-cased. An item counts as found in a text if a stretch has at least ``LEAST``
equal words, or four fifths of a shorter item; of an item under ``SPAN`` words all must be equal.

Cases: null and empty texts and items have no hits; repeated items are found each under its own id, an item without id
under a null; a document without id is searched like any other (its result has a null doc_id, and the text's digest);
repeated rows give one result for each id and text; equal stretches go to the first by start; further columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import LETTERS, hashed, mixed, multipliers, pieces, stored, unused, words

SPAN = 8
#: Together they hit every pattern of at most one substituted word in five, in items of 8 to 20 words.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 3, 4, 5, 6, 7), (0, 1, 2, 3, 5, 6), (0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 5, 7), (1, 2, 4, 5, 6, 7),
         (0, 1, 2, 3, 6, 7), (0, 2, 4, 5, 6, 7), (0, 1, 2, 4, 5, 7), (0, 1, 3, 4, 5, 6))
LEAST = 13
#: Equal words for each one that differs.
FEW = 4
MAP_BITS = 23


def masks_for(n: int) -> list[tuple[int, tuple[int, ...], int]]:
    """Span, positions and hash seed of the masks for an item of ``n`` words."""
    if n >= SPAN:
        return [(SPAN, mask, 77 + i) for i, mask in enumerate(MASKS)]
    return [(n, tuple(range(n)), 177 + n)] if n else []


def seed_hashes(own: np.ndarray, span: int, mask: tuple[int, ...], seed: int) -> np.ndarray:
    """Hash of the masked positions of each window over word hashes."""
    n = len(own) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for at, factor in zip(mask, multipliers(len(mask), seed), strict=True):
        out += own[at:at + n] * factor
    return mixed(out)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct, offsets = words(texts, LETTERS)
    return hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), offsets


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, words as binary), (key, item_id) and (hash, key, at) of a benchmark; ``key`` is a digest of the item's words."""

    def item_words(batches):
        for piece in pieces(batches):
            own, offsets = _word_hashes(piece.column("text"))
            items = [own[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_pydict({
                "item_id": piece.column("item_id"), "item": pa.array(items, pa.binary()),
                "key": pa.array([hashlib.blake2b(i, digest_size=16).digest() for i in items], pa.binary())})

    def seeds(batches):
        for batch in batches:
            for key, item in zip(batch.column("key").to_pylist(), batch.column("item").to_pylist()):
                own = np.frombuffer(item, np.uint64)
                found = [seed_hashes(own, *mask) for mask in masks_for(len(own))]
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)),
                    "key": pa.array([key] * sum(map(len, found)), pa.binary()),
                    "at": pa.array(np.concatenate([np.zeros(0, np.int32), *[np.arange(len(f), dtype=np.int32) for f in found]]))})

    every = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        item_words, "item_id long, item binary, key binary").filter(F.length("item") > 0).distinct(), "items")
    items = stored(every.select("key", "item").distinct(), "items")
    return items, every.select("key", "item_id"), items.mapInArrow(seeds, "hash long, key binary, at int").distinct()


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Two of 2 ** MAP_BITS places for each hash: at most 2 ** MAP_BITS / 64 rows reach the driver."""
    places = [F.shiftrightunsigned("hash", 64 - MAP_BITS),
              F.shiftrightunsigned("hash", 64 - 2 * MAP_BITS).bitwiseAND(F.lit((1 << MAP_BITS) - 1).cast("long"))]
    rows = (seeds.select(F.explode(F.array(*places)).alias("place")).select(
        F.shiftrightunsigned("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def regions(docs: DataFrame, seen: np.ndarray, reach: int, masks: list[tuple[int, tuple[int, ...], int]]) -> DataFrame:
    """Surroundings of windows whose hash may belong to an item: doc_id, digest of the text, first word, words, and the hits in it."""
    packed = np.packbits(seen)

    def run(batches):
        marks = np.unpackbits(packed).astype(bool)
        for piece in pieces(batches):
            own, offsets = _word_hashes(piece.column("text"))
            at, found, upto = [], [], []
            for mask in masks:
                hashes = seed_hashes(own, *mask)
                hit = np.flatnonzero(marks[hashes >> np.uint64(64 - MAP_BITS)])
                hit = hit[marks[(hashes[hit] >> np.uint64(64 - 2 * MAP_BITS)) & np.uint64((1 << MAP_BITS) - 1)]]
                at.append(hit)
                found.append(hashes[hit])
                upto.append(hit + mask[0])
            at, found, upto = np.concatenate(at), np.concatenate(found), np.concatenate(upto)
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = upto <= offsets[doc + 1] if len(at) else np.zeros(0, bool)
            order = np.flatnonzero(inside)[np.argsort(at[inside], kind="stable")]
            at, found, doc, upto = at[order], found[order], doc[order], upto[order]
            if not len(at):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)]))
            rows: dict[str, list] = {k: [] for k in ("start", "words", "at", "hash")}
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
                low, high = offsets[doc[a]], offsets[doc[a] + 1]
                first, last = max(at[a] - reach, low), min(upto[a:b].max() + reach, high)
                rows["start"].append(int(first - low))
                rows["words"].append(own[first:last].tobytes())
                rows["at"].append((at[a:b] - first).astype(np.int32))
                rows["hash"].append(found[a:b].astype(np.int64))
            texts = piece.column("text").take(pa.array(doc[cut]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id").take(pa.array(doc[cut])),
                "digest": pa.array([hashlib.md5(t.as_py().encode()).hexdigest() for t in texts], pa.string()),
                "start": pa.array(rows["start"], pa.int64()), "words": pa.array(rows["words"], pa.binary()),
                "at": pa.array(rows["at"], pa.list_(pa.int32())), "hash": pa.array(rows["hash"], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, digest string, start long, words binary, at array<int>, hash array<long>")


def best_stretch(own: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Of ``item`` laid at ``shift`` over ``own``: first word in ``own``, length and equal words of the best stretch."""
    low, high = max(shift, 0), min(shift + len(item), len(own))
    if high <= low:
        return 0, 0, 0
    same = own[low:high] == item[low - shift:high - shift]
    # A stretch has few enough differences if this sum does not fall over it. The longest one to each end begins at
    # the first place where the sum is as low; the lowest sums so far only fall, so that place is found by bisection.
    equal = np.concatenate([[0], np.cumsum(same)])
    score = equal - FEW * (np.arange(len(same) + 1) - equal)
    begins = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    end = int(np.argmax(equal - equal[begins]))
    inside = np.flatnonzero(same[begins[end]:end]) + begins[end]
    if not len(inside):
        return 0, 0, 0
    return int(low + inside[0]), int(inside[-1] - inside[0] + 1), len(inside)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: doc_id, digest (MD5 of the text), item_id, start (word of the text, from 0), length, n_equal, item_words."""
    items, names, seeds = item_seeds(benchmark)
    seeds = stored(seeds, "seeds")
    words_in = F.floor(F.length("item") / 8)
    longest = items.agg(F.max(words_in)).first()[0] or 0
    lengths = {r[0] for r in items.select(F.least(words_in, F.lit(SPAN))).distinct().collect()}  # ``SPAN`` numbers at most
    masks = [mask for n in sorted(lengths) for mask in masks_for(n)]
    none = "doc_id long, digest string, item_id long, start long, length long, n_equal long, item_words long"
    if not masks:
        return docs.sparkSession.createDataFrame([], none)
    around = stored(regions(docs, bitmap(seeds), max(longest, SPAN), masks).withColumn(
        "doc", F.concat_ws("|", "digest", F.col("doc_id").cast("string"))), "regions")
    hits = around.select("doc", "start", F.explode(F.arrays_zip("at", "hash")).alias("hit")).select(
        "doc", "start", F.col("hit.at").alias("place"), F.col("hit.hash").alias("hash"))
    aligned = (hits.join(seeds, "hash").select("doc", "start", "key", (F.col("place") - F.col("at")).alias("shift"))
               .distinct())
    pairs = aligned.join(around.select("doc", "doc_id", "digest", "start", "words"), ["doc", "start"]).join(items, "key")

    def verify(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "n_equal", "item_words")}
            for row, (start, shift, own, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "shift", "words", "item")))):
                item = np.frombuffer(item, np.uint64)
                begin, length, equal = best_stretch(np.frombuffer(own, np.uint64), item, shift)
                needed = len(item) if len(item) < SPAN else min(LEAST, -(-FEW * len(item) // (FEW + 1)))
                if equal >= needed:
                    for k, v in zip(rows, (row, start + begin, length, equal, len(item)), strict=True):
                        rows[k].append(v)
            kept = pa.array(rows.pop("row"), pa.int64())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(kept) for c in ("doc_id", "digest", "key")} | {
                k: pa.array(v, pa.int64()) for k, v in rows.items()})

    found = pairs.select("doc_id", "digest", "key", "start", "shift", "words", "item").mapInArrow(
        verify, "doc_id long, digest string, key binary, start long, length long, n_equal long, item_words long").distinct()
    return found.join(names, "key").select("doc_id", "digest", "item_id", "start", "length", "n_equal", "item_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text has no verified overlap; their columns as they were."""
    at, of = unused("leak", docs), unused("digest", docs)
    leaks = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias(at), F.col("digest").alias(of)).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(F.col(at)) & (F.md5(docs["text"]) == F.col(of)), "left_anti")
