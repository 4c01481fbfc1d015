"""Compression of vectors to codes: a codebook for each part of the dimensions, fitted by Ball k-means.

A codebook entry and the parts that have it are a ball: centre, and the largest distance of a member as its radius. Only entries whose
centre is at most two radii away (neighbours) can take a member over. A member nearer to its centre than half the way to the
nearest neighbour is in the stable core and keeps its code without another distance. The rest lies in rings: sorted by distance from the
centre, neighbour j counts for a member only if it is at most twice the member's own distance away, so members of a ring are
compared with the neighbours up to that ring's. If an entry has not moved since the last round, only neighbours that have
moved count. All comparisons are between squares of whole numbers, so nothing is lost to rounding, and a neighbour at
exactly twice the distance still counts (it may tie, and the lower index wins).

Vectors lie in chunks of a table; balls are taken within a chunk, which makes them smaller and leaves the result as it is.
A round rewrites the chunks with their new codes, and the sums of each chunk's parts by entry. The sums are added up in
tasks and by one shuffle of at most ``parts * entries`` rows from each task; the codebooks (as many rows) go through the
driver. The table of the round before is then removed.

Cases: vectors that are null, of another length, or hold a null, infinity or NaN are left out; a row without id is encoded
but no first entry; rows that repeat an id are vectors of their own; fewer than ``entries`` vectors with ids give fewer
entries, equal first vectors give equal entries of which the lowest is used; no vectors or no ids give no rows; a
component above 131,072 stops the job (distances would leave 64 bits); a table without the label column has
null labels; further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import stored
from fathom.llm.vectors import chunk_table, chunks, exact, floor_means, forget, joined_numbers, lists, seeds, squared, usable, whole_numbers

DIMS = 64
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rings of an entry that are compared together.
BANDS = 4
#: Parts compared with a whole codebook at once.
BLOCK = 4096
#: A part's entries now, and in the round before.
Entries = tuple[np.ndarray, np.ndarray | None]


class Book:
    """Entries of one part: who has moved since the round before, and each entry's others by distance."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.numbers = exact(entries)
        self.moved = np.ones(len(entries), bool) if before is None else (entries != before).any(axis=1)
        gaps = squared(entries, entries)
        order = np.argsort(gaps, axis=1, kind="stable")
        self.others, self.gaps = [], []
        for i, near in enumerate(order):
            near = near[(near != i) & (self.moved[i] | self.moved[near])]
            self.others.append(near)
            self.gaps.append(gaps[i, near])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Like ``squared``, for numbers whose type has been chosen before."""
    if x.dtype != y.dtype:
        x, y = x.astype(np.int64), y.astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]


def own_distances(x: np.ndarray, codes: np.ndarray, book: Book) -> np.ndarray:
    """Squared distance of each part from its entry."""
    away = x.astype(np.int64) - book.entries[codes]
    return (away * away).sum(axis=1)


def assigned(x: np.ndarray, book: Book) -> np.ndarray:
    """Nearest entry of each part, without knowing anything: the first round."""
    return np.concatenate([np.zeros(0, np.int64), *[
        _distances(x[at:at + BLOCK], book.numbers).argmin(axis=1) for at in range(0, len(x), BLOCK)]])


def reassigned(x: np.ndarray, codes: np.ndarray, book: Book) -> tuple[np.ndarray, int]:
    """Nearest entry of each part, from its entry in the round before; and how many distances were computed."""
    codes, out, computed = codes.astype(np.int64), codes.astype(np.int64), 0
    own = own_distances(x, codes, book)
    by_entry = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[by_entry], np.arange(len(book.entries) + 1))
    for entry in np.flatnonzero(np.diff(bounds)).tolist():
        members = by_entry[bounds[entry]:bounds[entry + 1]]
        reach = 4 * own[members]
        gaps = book.gaps[entry]
        neighbours = book.others[entry][:np.searchsorted(gaps, reach.max(), "right")]
        ring = np.searchsorted(gaps[:len(neighbours)], reach, "right")
        outside = np.flatnonzero(ring)
        if not len(outside):
            continue
        outside = outside[np.argsort(ring[outside], kind="stable")]
        for band in np.array_split(outside, min(BANDS, len(outside))):
            rows = members[band]
            among = np.sort(neighbours[:ring[band[-1]]])
            away = _distances(x[rows], book.numbers[among])
            computed += away.size
            at = away.argmin(axis=1)
            best = away[np.arange(len(rows)), at]
            better = (best < own[rows]) | ((best == own[rows]) & (among[at] < entry))
            out[rows[better]] = among[at[better]]
    return out, computed


def _parts(numbers: np.ndarray, parts: int) -> list[np.ndarray]:
    return [exact(p) for p in np.split(numbers, parts, axis=1)]


def _summed(numbers: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """parts x entries x (1 + width): how many parts have an entry, and their sum."""
    parts = codes.shape[1]
    out = np.zeros((parts, entries, 1 + numbers.shape[1] // parts), np.int64)
    for p, own in enumerate(np.split(numbers.astype(np.int64), parts, axis=1)):
        order = np.argsort(codes[:, p], kind="stable")
        present, first, count = np.unique(codes[order, p], return_index=True, return_counts=True)
        out[p, present, 0] = count
        out[p, present, 1:] = np.add.reduceat(own[order], first, axis=0)
    return out


def _numbers(batch: pa.RecordBatch, row: int, dims: int) -> np.ndarray:
    kind = np.int32 if batch.column("wide")[row].as_py() else np.int16
    return np.frombuffer(batch.column("numbers")[row].as_py(), kind).reshape(-1, dims).astype(np.int32)


def _codes(batch: pa.RecordBatch, row: int, parts: int) -> np.ndarray:
    return np.frombuffer(batch.column("codes")[row].as_py(), np.uint8).reshape(-1, parts)


def _recoded(numbers: np.ndarray, codes: np.ndarray, books: list[Book]) -> np.ndarray:
    return np.stack([reassigned(x, codes[:, p], books[p])[0] for p, x in enumerate(_parts(numbers, len(books)))], axis=1)


def _first_chunks(kept: DataFrame, books: list[Entries], dims: int, schema: str) -> DataFrame:
    """Chunks of vectors with the codes of the first round."""
    parts, entries = len(books), len(books[0][0])

    def run(batches):
        made = [Book(*b) for b in books]
        for chunk in chunks(batches):
            numbers = whole_numbers(chunk.column(2), dims)
            codes = np.stack([assigned(x, made[p]) for p, x in enumerate(_parts(numbers, parts))], axis=1)
            wide = bool(np.abs(numbers).max() > 32767)
            yield pa.RecordBatch.from_pydict({
                "ids": lists(chunk.column(0)), "labels": lists(chunk.column(1)), "wide": [wide],
                "numbers": [(numbers if wide else numbers.astype(np.int16)).tobytes()],
                "codes": [codes.astype(np.uint8).tobytes()], "sums": [_summed(numbers, codes, entries).tobytes()]})

    return kept.mapInArrow(run, schema)


def _next_chunks(rows: DataFrame, books: list[Entries], dims: int, schema: str) -> DataFrame:
    """The same chunks with the codes of the next round."""
    parts, entries = len(books), len(books[0][0])

    def run(batches):
        made = [Book(*b) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                numbers = _numbers(batch, row, dims)
                codes = _recoded(numbers, _codes(batch, row, parts), made)
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(row, 1) for c in ("ids", "labels", "wide", "numbers")} | {
                    "codes": pa.array([codes.astype(np.uint8).tobytes()], pa.binary()),
                    "sums": pa.array([_summed(numbers, codes, entries).tobytes()], pa.binary())})

    return rows.mapInArrow(run, schema)


def _updated(rows: DataFrame, books: list[Entries], dims: int) -> list[Entries]:
    """Codebooks of the floored means."""
    parts, entries = len(books), len(books[0][0])
    width = dims // parts

    def run(batches):
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            for sums in batch.column(0):
                total += np.frombuffer(sums.as_py(), np.int64).reshape(total.shape)
        part, entry = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32),
                                          "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    added = rows.select("sums").mapInArrow(run, "part int, entry int, sums array<long>").groupBy("part", "entry").agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(1 + width)]).alias("sums")).collect()
    total = np.zeros((parts, entries, 1 + width), np.int64)
    for r in added:
        total[r.part, r.entry] = r.sums
    return [(floor_means(t[:, 0], t[:, 1:], now), now) for t, (now, _) in zip(total, books)]


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS,
               vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable vector. ``entries`` is 256 at most."""
    if not 0 < entries <= 256 or dims % parts:
        raise ValueError("a code has two hex digits for each of equal parts")
    spark = vectors.sparkSession
    label_of = F.col(label) if label in vectors.columns else F.lit(None).cast("int")
    kept = vectors.filter(usable(embedding, dims)).select(
        F.col(vec_id).cast("long").alias("vec_id"), label_of.alias("label"), F.col(embedding).alias("embedding"))
    kind = kept.schema["label"].dataType.simpleString()
    first = seeds(kept.filter("vec_id IS NOT NULL"), [F.col("vec_id")], entries, "embedding", dims)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = [(b, None) for b in np.split(first, parts, axis=1)]
    schema = f"ids array<long>, labels array<{kind}>, wide boolean, numbers binary, codes binary, sums binary"
    rows, path = chunk_table(_first_chunks(kept, books, dims, schema), "codes")
    books = _updated(rows, books, dims)
    for _ in range(rounds - 1):
        after, newer = chunk_table(_next_chunks(rows, books, dims, schema), "codes")
        forget(spark, path)
        rows, path = after, newer
        books = _updated(rows, books, dims)

    def run(batches):
        made = [Book(*b) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                numbers = _numbers(batch, row, dims)
                codes = _recoded(numbers, _codes(batch, row, parts), made)
                error = sum(own_distances(x, codes[:, p], made[p]) for p, x in enumerate(_parts(numbers, parts)))
                text = codes.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("ids")[row].values, "label": batch.column("labels")[row].values,
                    "code": pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]), "error": error})

    done = stored(rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "encoded")
    forget(spark, path)
    # A table of its own, so that the join with it can split a label that very many rows share.
    by_label = stored(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "errors")
    digest = hashlib.sha256(",".join(joined_numbers(b) for b, _ in books).encode()).hexdigest()
    return done.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
