"""Operators over vectors, and sharding, against brute force on small tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import centroids, codebooks, sharding
from fathom.llm.queries import QUERIES
from fathom.llm.vectors import squared, whole_numbers

import pyarrow as pa

DIMS = 8


def lines(rows):
    return Counter(tuple(r) for r in rows)


def floors(v):
    return [int(np.floor(1024 * float(np.float32(x)))) for x in v]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Ties, repeated rows and ids, unusable vectors, no id, and columns with names that the operators use inside."""
    rng = random.Random(4)
    some = [[rng.choice([-0.5, 0.25, 0.26, 1.0, rng.uniform(-1, 1)]) for _ in range(DIMS)] for _ in range(60)]
    rows = [(i, v, i % 3 or None) for i, v in enumerate(some)]
    rows += [(i, [0.5] * DIMS, 7) for i in range(100, 150)]  # one very common vector
    rows += [(3, some[3], 0), (3, some[4], 0), (200, some[5], 1), (None, some[6], None), (None, [3.0] * DIMS, 1)]
    rows += [(300, None, 1), (301, [1.0] * (DIMS - 1), 1), (302, [float("nan")] + [0.0] * (DIMS - 1), 1), (303, [], None),
             (304, [None] + [1.0] * (DIMS - 1), 1), (305, [float("inf")] + [1.0] * (DIMS - 1), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    return df.withColumns({"ids": F.lit(1), "codes": F.lit("x"), "cluster": F.lit(9), "of": F.lit(2), "error": F.lit(0)})


def usable(rows):
    return [(r.vec_id, floors(r.embedding), r.label, list(r.embedding)) for r in rows if r.embedding and len(r.embedding) == DIMS
            and all(x is not None and np.isfinite(x) for x in r.embedding)]


def nearest(v, centres):
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))


def moved(of, vectors, centres):
    out = []
    for i, c in enumerate(centres):
        own = [v for o, v in zip(of, vectors) if o == i]
        out.append([sum(x) // len(own) for x in zip(*own)] if own else c)
    return out


def test_centroids_against_brute_force(odd_vectors):
    rows = usable(odd_vectors.collect())
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), e, v) for i, v, _, e in rows if i is not None)[:5]
    centres, vectors = [v for _, _, v in first], [v for _, v, _, _ in rows]
    for _ in range(4):
        centres = moved([nearest(v, centres)[1] for v in vectors], vectors, centres)
    ends = [nearest(v, centres) for v in vectors]
    inertia = Counter()
    for d, c in ends:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = [(i, c, d, inertia[c], sum(inertia.values()), names[c]) for (i, _, _, _), (d, c) in zip(rows, ends)]
    got = centroids.clustered(odd_vectors, k=5, rounds=4, dims=DIMS)
    assert lines(got.collect()) == lines(want)


def test_blocks_are_lossless_and_widen_where_it_pays():
    rng = np.random.default_rng(1)
    numbers = rng.integers(-500, 500, (4000, 16)).astype(np.int32)
    found = centroids.blocks(numbers)
    assert np.array_equal(np.hstack([e[c] for e, c in found]), numbers) and len(found) == 16
    few = numbers[rng.integers(0, 20, 4000)]
    found = centroids.blocks(few)
    assert np.array_equal(np.hstack([e[c] for e, c in found]), few)
    assert len(found) == 1 and len(found[0][0]) == 20  # whole vectors are the entries
    mixed = np.hstack([few[:, :4], numbers[:, :3], few[:, :6]])
    found = centroids.blocks(mixed)
    assert np.array_equal(np.hstack([e[c] for e, c in found]), mixed) and 1 < len(found) < 13
    centres = rng.integers(-500, 500, (7, 13))
    cluster, distance = centroids.nearest(found, centres)
    want = ((mixed[:, None].astype(int) - centres[None]) ** 2).sum(2)
    assert np.array_equal(cluster, want.argmin(1)) and np.array_equal(distance, want.min(1))
    sums = centroids.gathered(found, cluster, 7)
    assert all(np.array_equal(sums[i], mixed[cluster == i].sum(0)) for i in range(7))


def test_codebooks_against_brute_force(odd_vectors):
    rows = usable(odd_vectors.collect())
    first = [v for _, _, v in sorted((i, e, v) for i, v, _, e in rows if i is not None)[:12]]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(2):
        cut = lambda v: v[p * 4:p * 4 + 4]
        parts, book = [cut(v) for _, v, _, _ in rows], [cut(v) for v in first]
        for _ in range(3):
            book = moved([nearest(x, book)[1] for x in parts], parts, book)
        books += book
        for at, x in enumerate(parts):
            d, c = nearest(x, book)
            errors[at] += d
            codes[at].append(f"{c:02x}")
    of_label = Counter()
    for (_, _, label, _), e in zip(rows, errors):
        of_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b).encode()).hexdigest()
    want = [(i, "".join(c), e, of_label[label], digest) for (i, _, label, _), c, e in zip(rows, codes, errors)]
    got = codebooks.compressed(odd_vectors, parts=2, entries=12, rounds=3, dims=DIMS)
    assert lines(got.collect()) == lines(want)


@pytest.mark.parametrize("spread", [3, 40, 5000])
def test_rings_leave_out_nothing(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (3000, 3))
    x[:900] = x[0]
    first = codebooks.Book(x[np.arange(0, 3000, 60)].copy())
    codes = codebooks.assigned(x.astype(float), first)
    before = first.entries
    for turn in range(4):
        entries = before.copy()
        for i in range(turn % 2, len(entries), 2):  # half of the entries stay where they are
            own = x[codes == i]
            entries[i] = own.sum(0) // len(own) if len(own) else entries[i]
        book = codebooks.Book(entries, before)
        codes, computed = codebooks.reassigned(x.astype(float), codes, book)
        assert np.array_equal(codes, squared(x, entries).argmin(1))
        before = entries
    assert computed < x.shape[0] * len(entries) / 2


def test_vectors_at_the_limits(spark):
    big = spark.createDataFrame([(i, [float(x) for x in (131_072, -131_072, i, 0)]) for i in range(40)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in centroids.clustered(big, k=40, rounds=1, dims=4).collect()}
    assert len({r.cluster for r in got.values()}) == 40 and all(r.distance == 0 for r in got.values())
    assert {r.error for r in codebooks.compressed(big, parts=2, entries=40, dims=4).collect()} == {0}
    with pytest.raises(ValueError):
        whole_numbers(pa.array([[131_073.0]]), 1)
    empty = big.limit(0)
    assert centroids.clustered(empty, dims=4).count() == 0 and codebooks.compressed(empty, dims=4).count() == 0
    no_ids = big.withColumn("vec_id", F.lit(None).cast("long"))
    assert centroids.clustered(no_ids, dims=4).count() == 0 and codebooks.compressed(no_ids, dims=4).count() == 0


# ---- 13: sharding -------------------------------------------------------------------------------------------------------

def naive_best_fit(sizes, capacity):
    room, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        if not fits:
            fits = [(capacity, len(room))]
            room.append(capacity)
        b = min(fits)[1]
        room[b] -= sizes[i]
        out[i] = b
    return out


def test_best_fit_is_the_naive_one():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.choice([rng.randint(1, 100), 7, 50]) for _ in range(rng.randint(1, 150))]
        capacity = max(sizes) + rng.randint(0, 200)
        assert sharding.best_fit_decreasing(sizes, capacity) == naive_best_fit(sizes, capacity)


def test_shards_are_even():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 2000) for _ in range(rng.randint(200, 900))] + [rng.randint(50_000, 400_000) for _ in range(rng.randint(0, 4))]
        into = sharding.shards_of(sizes, 12)
        load = Counter()
        for s, i in zip(sizes, into):
            load[i] += s
        alone = {i for i, n in Counter(into).items() if n == 1}
        rest = [load[i] for i in range(12) if i not in alone]
        assert all(load[i] * len(rest) >= sum(rest) for i in alone)
        assert set(into) <= set(range(12)) and max(rest) - min(rest) <= 2000
    assert sharding.shards_of([], 4) == [] and sharding.shards_of([5], 4) == [0] and len(set(sharding.shards_of([9, 9, 9], 4))) == 3


def laws(rows, texts, shards):
    """Groups whole, slots gapless, sizes and checksums right."""
    assert lines((r.doc_id, r.size, r.text_crc32) for r in rows) == lines(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = defaultdict(set)
    ids = {i: t for i, t in texts}
    for r in rows:
        if r.doc_id is not None:
            of[ids[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_sharding_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op13_sharding"](spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    laws(rows, texts, 24)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    largest = max(Counter({t: 0}) and (len(t.encode()) + 8) * n for t, n in Counter(t for _, t in texts if t).items())
    assert max(load.values()) - min(load.values()) <= max(largest, sum(load.values()) // 24 // 20)


def test_sharding_on_odd_rows(spark, tmp_path):
    texts = [(i, "copy " * 50) for i in range(400)] + [(i, f"text {i} " * (i % 90)) for i in range(400, 900)]
    texts += [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "same"), (1004, "same"), (None, "none"), (1005, "é" * 40_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    df = df.withColumns({"digest": F.lit("d"), "shard": F.lit("mine"), "size": F.lit(1), "of": F.lit(0), "row": F.lit(3), "part": F.lit(1)})
    rows = sharding.placements(df, shards=5).collect()
    laws(rows, texts, 5)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    copies = next(r.shard for r in rows if r.doc_id == 0)
    rest = [load[i] for i in range(5) if i != copies]
    assert load[copies] == 400 * 258 or load[copies] <= max(rest)
    assert max(rest) - min(rest) <= max(80_008, sum(rest) // 100)
    assert sorted(rows, key=str) == sorted(sharding.placements(df.repartition(3), shards=5).collect(), key=str)
    assert sharding.placements(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard_"}
    assert lines(back.select(*df.columns).collect()) == lines(df.collect())
    of = {r.doc_id: r.shard for r in rows}
    assert all(of[r.doc_id] == r.shard_ for r in back.collect())
    few = sharding.placements(df.filter("doc_id < 3 OR doc_id = 500"), shards=5).collect()
    assert len(few) == 4 and len({r.shard for r in few}) == 2


def test_rooms_stay_balanced():
    rooms = sharding.Rooms()
    for i in range(2000):
        rooms.add(i, i)
    assert rooms.root[3] <= 16
    taken = [rooms.take_tightest(s) for s in (500, 500, 1999, 1999)]
    assert [t and t[0] for t in taken] == [500, 501, 1999, None]
    assert list(itertools.takewhile(bool, (rooms.take_tightest(0) for _ in range(3)))) == [(0, 0), (1, 1), (2, 2)]
