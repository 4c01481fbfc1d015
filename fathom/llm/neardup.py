"""Near duplicates by HyperMinHash over word shingles.

One 64-bit hash per shingle; its top bits choose one of ``BUCKETS`` registers, the smallest rest in a bucket is kept as the
count of its leading zeros and ``MANTISSA`` bits after them (16 bits a register). Texts that agree in all registers of
a band are candidates; their Jaccard similarity is estimated from equal registers, less those expected to be equal by
chance, and pairs far below the limit are dropped. Each register that differs stands for a shingle that only one of the two
has, so pairs with too many of them are dropped for certain, whatever their size. What is left is verified on the full shingle
sets; these are made for the texts of such pairs alone, where the texts lie: a table of bits, of bounded size, picks them, so no
text is shuffled.

No group is ever expanded into all pairs. Texts with equal sets first become one vertex. A vertex is *central* in the degree of
how many others it meets over all bands: in a group of copies of one text, edited here and there, that is the text with
the fewest edits, to which most of the others are linked. So each vertex is first compared with the most central one that it
meets, one pair for each vertex. Links so far give classes. In buckets with several classes left, all are compared with the
``HUBS`` most central ones. Buckets of ``HUBS + 1`` are then settled; what is still in different classes of a larger bucket is
settled exactly by an inverted index of each set's rarest shingles, with bounds by size, place and parity bits. There, shingles that
no other set has count against a set, so that one that is far from the central text of its group meets nothing; and two sets whose
bits differ in too many places are no pair. Up to about ``64 * PARITY / 4`` shingles, that leaves little but links.

Cases: texts without words (null, empty, blanks) have an empty set and are linked with nothing; texts under
``WORDS`` words have one shingle, the whole sequence; rows that repeat an id are one vertex for each set, and versions of
one id are linked; a row without id has no class (null) and is kept, whatever its text; further columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.shared import LOWER, distinct_sorted, hashed, mixed, multipliers, pieces, stored, unused, words

WORDS = 5
LIMIT = 75  # per cent
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 4  # registers of a band
HUBS = 3  # members of a bucket with which all others are compared
#: Estimates this far under the limit are dropped: five standard deviations of BUCKETS registers.
SLACK = 5 * (0.75 * 0.25 / BUCKETS) ** 0.5
#: Sets up to this size have too few full registers for an estimate and are verified at once.
SMALL = 64
#: Longs of parity bits that stand for a set, and the uses of a shingle from which they are looked at.
PARITY = 32
OFTEN = 16
#: Rows, at most, of the table of bits that picks documents; each has 64 bits.
SLOTS = 1 << 20
_EDGES = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
_M = multipliers(WORDS, 5)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    codes, distinct, offsets = words(texts, LOWER)
    own = hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(own) - WORDS + 1
    sums = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS if n > 0 else 0):
        sums += own[k:k + n] * _M[k]
    sums = mixed(sums)
    out = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if high - low >= WORDS:
            out.append(distinct_sorted(sums[low:high - WORDS + 1]))
        elif high > low:
            whole = (own[low:high] * _M[:high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers of each set: 0 if no shingle fell into the bucket."""
    least, full = np.zeros((len(sets), BUCKETS), np.uint64), np.zeros((len(sets), BUCKETS), bool)
    for row, own in enumerate(sets):
        if len(own):
            at = np.searchsorted(own, _EDGES)
            value = own[np.minimum(at, len(own) - 1)]
            full[row] = (at < len(own)) & ((value >> np.uint64(64 - BUCKET_BITS)) == np.arange(BUCKETS, dtype=np.uint64))
            least[row] = value << np.uint64(BUCKET_BITS)
    exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    after = (least << zeros) << np.uint64(1)
    return np.where(full, ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA)), 0).astype(np.uint16)


def band_keys(own: np.ndarray) -> list[np.ndarray]:
    """Keys of the bands that are not empty."""
    bands = own.reshape(len(own), BUCKETS // ROWS, ROWS).astype(np.uint64)
    sums = (bands * multipliers(ROWS, 9)).sum(axis=2, dtype=np.uint64)
    keys = mixed(sums + multipliers(BUCKETS // ROWS, 13)).astype(np.int64)
    return [k[b] for k, b in zip(keys, bands.any(axis=2))]


def chance(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Expected share of registers that are equal though their shingles differ, for sets of these sizes."""
    level = np.arange(1, 64 - BUCKET_BITS)
    high, low = 2.0 ** -(BUCKET_BITS + level - 1), 2.0 ** -(BUCKET_BITS + level)
    inside = lambda n: np.exp(n[:, None] * np.log1p(-low)) - np.exp(n[:, None] * np.log1p(-high))
    return (inside(sizes_a.astype(float)) * inside(sizes_b.astype(float))).sum(axis=1) / (1 << MANTISSA)


def estimated(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for equal ones by chance."""
    full = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    return np.clip((equal - BUCKETS * chance(sizes_a, sizes_b)) / np.maximum(full, 1), 0, 1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), digest of the set, registers, band keys."""

    def run(batches):
        for piece in pieces(batches):
            sets = shingle_sets(piece.column("text"))
            own = registers(sets)
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([_digest(s) for s in sets], pa.binary()),
                "registers": pa.array([r.tobytes() for r in own], pa.binary()),
                "bands": pa.array(band_keys(own), pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, digest binary, registers binary, bands array<long>")


def classes_of(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``links`` (a, b): rows (v, c).

    Each round takes the smallest label among the neighbours and then that label's own label, which halves distances. After
    ``rounds`` of them, some vertices of a class may still have different labels; none has that of another class.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")), "labels")
    while rounds is None or rounds > 0:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("w")).agg(F.min("c").alias("near"))
        lower = labels.join(near, labels["v"] == near["w"], "left").select("v", "c", F.least("c", "near").alias("d"))
        own = lower.select(F.col("v").alias("u"), F.col("d").alias("e"))
        after = stored(lower.join(own, F.col("d") == F.col("u"), "left").select(
            "v", F.least("d", "e").alias("c"), (F.least("d", "e") != F.col("c")).alias("moved")), "labels")
        labels = after.select("v", "c")
        if rounds is not None:
            rounds -= 1
        elif not after.filter("moved").limit(1).count():
            return labels
    return labels


#: Pairs of vertices: digests, and their first documents.
PAIR = "a binary, b binary, x long, y long"


def _screened(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs whose estimate does not rule them out."""
    one = sketch.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    two = sketch.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            good = (np.minimum(na, nb) <= SMALL) | (estimated(ra, rb, na, nb) >= LIMIT / 100 - SLACK) if len(na) else np.zeros(0, bool)
            good &= (100 + LIMIT) * (ra != rb).sum(axis=1) <= (100 - LIMIT) * (na + nb)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good)) for c in ("a", "b", "x", "y")})

    # Merged at any size, here and below: pairs are as many as there are texts.
    return pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").mapInArrow(run, PAIR)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= LIMIT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b", "x", "y")})

    one, two = (sets.select(F.col("digest").alias(v), F.col("members").alias(f"s{v}")) for v in ("a", "b"))
    return pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").mapInArrow(run, PAIR)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents ``ids`` (doc_id), and a few others. The bits that stand for the ids are sent to the documents."""
    code = F.xxhash64(F.col("doc_id").cast("long"))
    slot = F.pmod(code, F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(code, 58).cast("int"))
    bits = stored(ids.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")), "bits")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.join(F.broadcast(bits), slot == F.col("slot")).filter(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "text")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full shingle sets (digest, members) of the vertices ``wanted`` (digest, first)."""

    def run(batches):
        for piece in pieces(batches):
            sets = shingle_sets(piece.column("text"))
            yield pa.RecordBatch.from_pydict({"digest": pa.array([_digest(s) for s in sets], pa.binary()),
                                              "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    found = _picked(docs, wanted.select(F.col("first").alias("doc_id"))).mapInArrow(run, "digest binary, members binary")
    return found.hint("merge").join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def _compatible(x: F.Column, y: F.Column) -> F.Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(x, y) >= LIMIT * F.greatest(x, y)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """``PARITY`` longs for each set: bits that tell whether an odd number of its shingles fell there.

    Two sets' bits differ in no more places than there are shingles that only one of them has.
    """
    out = np.zeros((len(sets), 64 * PARITY), np.uint8)
    for row, own in enumerate(sets):
        out[row] = np.bincount((own % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(out, axis=1).view(np.int64)


def _near_enough(n: F.Column, m: F.Column, bits: F.Column, other: F.Column) -> F.Column:
    """Sets of these sizes and parity bits can be similar enough; without bits, they may be."""
    differing = F.aggregate(F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return F.coalesce((100 + LIMIT) * differing <= (100 - LIMIT) * (n + m), F.lit(True))


def _prefix_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different classes among ``left`` (number, digest, first, n, c) that may be similar; none that is similar is missing.

    Shingles are ranked from rare to frequent. Two similar sets share a shingle among the first quarter of each, and
    where it stands bounds what they can have in common. A passage that many texts share is frequent, so it
    stands at the end and brings no pairs unless it is nearly all there is to the texts. Sets that share a shingle with
    many others bring their parity bits along, so that the members of a large group are no pairs because they share a few.
    """

    def spread(batches):
        for batch in batches:
            own = [np.frombuffer(m, np.uint64) for m in batch.column("members").to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            bits = pa.array(parities(own).reshape(-1))
            yield pa.RecordBatch.from_pydict({
                "number": batch.column("number"),
                "shingles": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))),
                "bits": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * PARITY, pa.int32()), bits)})

    held = stored(left.join(sets, "digest").select("number", "members").mapInArrow(
        spread, "number long, shingles array<long>, bits array<long>"), "shingles")
    every = held.select("number", F.explode("shingles").alias("shingle"))
    times = every.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    # Only shingles that others have too can meet; those of its own take up a set's first places.
    own = Window.partitionBy("number")
    after = F.row_number().over(own.orderBy("times", "shingle")) - 1
    ranked = every.join(times, "shingle").select("number", "shingle", "times", after.alias("after"), F.count("*").over(own).alias("shared"))
    place = F.col("n") - F.col("shared") + F.col("after")
    first = F.col("n") - F.ceil(F.col("n") * LIMIT / 100) + 1
    front = ranked.join(left.select("number", "n", "c"), "number").withColumn("place", place).filter(F.col("place") < first)
    front = front.join(held.select("number", "bits"), "number").select(
        "shingle", "number", "n", "c", "place", F.when(F.col("times") >= OFTEN, F.col("bits")).alias("bits"))
    front = stored(front, "prefixes")
    other = front.toDF("shingle", "other", "m", "d", "at", "its")
    needed = LIMIT * (F.col("n") + F.col("m")) / (100 + LIMIT)
    possible = 1 + F.least(F.col("n") - F.col("place") - 1, F.col("m") - F.col("at") - 1)
    pairs = front.join(other, "shingle").filter(
        (F.col("c") < F.col("d")) & _compatible(F.col("n"), F.col("m")) & (possible >= needed - 1e-6)
        & _near_enough(F.col("n"), F.col("m"), F.col("bits"), F.col("its"))).select("number", "other").distinct()
    name = left.select("number", F.struct("digest", "first").alias("name"))
    named = pairs.join(name.toDF("number", "one"), "number").join(name.toDF("other", "two"), "other")
    return named.select(*_ordered(F.col("one"), F.col("two")))


def _with_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes, F.col("first") == F.col("v"), "left").withColumn("c", F.coalesce("c", "first")).drop("v")


def _open(members: DataFrame) -> DataFrame:
    """key and times (number of members) of the buckets with more than one class."""
    return members.groupBy("key").agg((F.min("c") != F.max("c")).alias("open"), F.count("*").alias("times")).filter("open").drop("open")


def _hubs(members: DataFrame) -> DataFrame:
    """key, hub, m, d: digest, size and class of the ``HUBS`` most central members of each bucket. Tasks send no more of a bucket."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("central"), F.desc("digest")))
    return members.withColumn("rank", rank).filter(F.col("rank") <= HUBS).select(
        "key", F.struct("digest", "first").alias("hub"), F.col("n").alias("m"), F.col("c").alias("d"))


def _ordered(one: F.Column, two: F.Column) -> list[F.Column]:
    """Two vertices (digest, first) as a pair."""
    low, high = F.least(one, two), F.greatest(one, two)
    return [low["digest"].alias("a"), high["digest"].alias("b"), low["first"].alias("x"), high["first"].alias("y")]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (the document stands for its class)."""
    sketch = stored(sketches(docs), "sketches")
    # A table of its own, so that the joins with it can split a digest that very many copies share.
    vertices = sketch.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "registers", "bands")])
    # Numbers stand for the vertices while their bands are dealt; they are fixed by being written once.
    vertices = stored(vertices.withColumn("number", F.monotonically_increasing_id()), "vertices")
    copies = stored(sketch.select("doc_id", "n", "digest").join(vertices.select("digest", "first"), "digest", "left"), "copies")
    listed = vertices.select("number", "n", F.explode("bands").alias("key"))
    # Two sets alone in a bucket whose sizes rule them out need not be looked at.
    shared = listed.groupBy("key").agg(F.count("*").alias("times"), F.min("n").alias("low"), F.max("n").alias("high")).filter(
        (F.col("times") > 2) | ((F.col("times") == 2) & _compatible(F.col("low"), F.col("high"))))
    shared = stored(shared.select("key", "times"), "keys")
    met = stored(listed.select("number", "key").join(shared, "key"), "met")
    central = vertices.select("number", "digest", "first", "n").join(met.groupBy("number").agg(F.sum("times").alias("central")), "number")
    # Members, too, are merged with what is drawn from them at any size.
    members = stored(met.select("number", "key").hint("merge").join(central, "number").drop("number"), "members")
    me = F.struct("digest", "first")

    def linked(pairs: DataFrame) -> DataFrame:
        """Verified pairs as links between first documents."""
        pairs = stored(pairs, "screened")
        wanted = pairs.select(F.col("a").alias("digest"), F.col("x").alias("first")).union(pairs.select("b", "y")).distinct()
        found = _verified(pairs, stored(_sets(docs, wanted), "sets")).filter("x != y")
        return stored(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "links")

    versions = copies.filter("first IS NOT NULL AND doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    several = sketch.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x != y")
    links = stored(versions.join(several.select(F.col("doc_id").alias("a")), "a", "left_semi").select("a", "b"), "links")

    # Each vertex with the most central one that it meets.
    top = F.struct("central", "digest", "first", "n")
    hubs = members.groupBy("key").agg(F.max(top).alias("hub"))
    near = members.hint("merge").join(hubs, "key").filter((F.col("digest") != F.col("hub.digest")) & _compatible(F.col("n"), F.col("hub.n")))
    best = near.groupBy("digest", "first").agg(F.max("hub").alias("hub"))
    tested = stored(best.select(*_ordered(me, F.struct("hub.digest", "hub.first"))).distinct(), "pairs")
    links = links.union(linked(_screened(tested, vertices)))

    # All of a bucket with its most central ones, where more than one class is left.
    own = stored(_with_classes(members, classes_of(links, 1)), "members")
    open_ones = _open(own)
    central_ones = stored(open_ones.join(_hubs(own), "key"), "hubs")
    near = own.hint("merge").join(central_ones, "key").filter((F.col("c") != F.col("d")) & _compatible(F.col("n"), F.col("m")))
    pairs = near.select(*_ordered(me, F.col("hub"))).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    tested = tested.union(pairs := stored(pairs.select(*tested.columns), "pairs"))
    links = links.union(linked(_screened(pairs, vertices)))

    # What is left in larger buckets, but for those with which all others have been compared. Numbers of eight bytes stand for
    # the sets while their shingles are dealt; they are fixed by being written once.
    large = open_ones.filter(F.col("times") > HUBS + 1).select("key")
    done = central_ones.select("key", F.col("hub.digest").alias("digest"))
    left = own.join(large, "key").join(done, ["key", "digest"], "left_anti").select("digest", "first", "n", "c").distinct()
    left = stored(left.withColumn("number", F.monotonically_increasing_id()), "open")
    if left.limit(1).count():
        pairs = _prefix_pairs(left, _sets(docs, left.select("digest", "first"))).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        links = links.union(linked(pairs.select(*tested.columns)))
    classes = classes_of(links)
    label = copies.join(classes, copies["first"] == classes["v"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "first", "doc_id")).alias("component_id"))
    return label.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows whose document stands for its class, with their columns as they were."""
    name = unused("gone", docs)
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
