"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over whole code points (order 4); each one is a symbol of its own, whatever its script. It is trained on
all trusted rows but a fifth by hash, whole texts. Tasks send their distinct n-grams with counts; contexts and
continuation counts are joined shard by shard. The finished table, which is as large as these texts have different n-grams of
four characters, then meets the documents where they lie: scoring shuffles no text. Windows of the ``_SYMBOLS`` - 2 commonest characters are read from a
dense copy of the table, all others are looked up.

A document goes if its perplexity is above a quantile of its own language's trusted documents; all of them count but those
the model was trained on, so that is the fifth left out. A short text says little, so each text is scored together with ``PRIOR`` characters of its
language's mean. Trusted are rows labelled as good; whether they are toxic is another label, which is not looked at.

Cases: null and empty texts have the mean and stay; a language with under ``LEAST_HELD`` such documents uses all languages'
quantile (a null language is the empty one); without any trusted text every document stays (threshold null); repeated rows are
judged alike; further columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.shared import flat, pieces, stored, unused

#: Most trusted ids, 8 bytes each, that are sent to the documents instead of being joined to them.
MOST_SENT = 2_000_000
QUANTILE = 0.998
#: Bytes of text that a task takes apart at once: each character has some ten numbers of eight bytes for a while.
PIECE = 1 << 20
#: Parts of an octave to which perplexities are counted for the quantile.
BINS = 4096
PRIOR = 100
LEAST_HELD = 20
ORDER = 4
_BITS = 6
_SYMBOLS = 1 << _BITS
_BEFORE, _RARE = 0, 1


_POINT = 21
_LAST = (1 << _POINT) - 1


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


@dataclass
class Model:
    """``contexts[k]`` has sorted contexts and the weight of the lower order, ``terms[k]`` sorted keys (place of the context,
    symbol) and discounted probabilities, k = order. A symbol is a code point + 1, or 0 before a text; a context packs the
    k - 1 symbols before, 21 bits each. ``letters`` are the commonest code points, ``size`` counts all symbols."""

    letters: list[int]
    size: int
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    terms: dict[int, tuple[np.ndarray, np.ndarray]]
    name: str

    def probability(self, context: np.ndarray, symbol: np.ndarray, order: int = ORDER) -> np.ndarray:
        """P(symbol | the ``order`` - 1 symbols before); unseen contexts fall back whole."""
        out = np.full(len(symbol), 1 / self.size)
        for k in range(1, order + 1):
            (contexts, weights), (keys, values) = self.contexts[k], self.terms[k]
            place, there = _found(contexts, context & ((1 << (_POINT * (k - 1))) - 1))
            out[there] *= weights[place[there]]
            at, seen = _found(keys, (place << _POINT) | symbol)
            seen &= there
            out[seen] += values[at[seen]]
        return out

    def log_table(self) -> np.ndarray:
        """log10 P(last symbol | ``ORDER`` - 1 symbols before) by n-gram over ``letters``."""
        points = np.concatenate([[0, 0], np.array(self.letters, np.int64) + 1])
        to = np.full(_LAST + 1, -1, np.int64)
        to[points[2:]] = np.arange(2, len(points))
        to[0] = _BEFORE
        dense = lambda packed, n: sum(to[(packed >> (_POINT * j)) & _LAST] << (_BITS * j) for j in range(n)) if n else np.zeros(len(packed), np.int64)
        inside = lambda packed, n: np.all([to[(packed >> (_POINT * j)) & _LAST] >= 0 for j in range(n)], axis=0) if n else np.ones(len(packed), bool)
        lower = np.full(_SYMBOLS, 1 / self.size, np.float32)
        for k in range(1, ORDER + 1):
            (contexts, shares), (keys, values) = self.contexts[k], self.terms[k]
            weight = np.ones(_SYMBOLS ** (k - 1), np.float32)
            good = inside(contexts, k - 1)
            weight[dense(contexts[good], k - 1)] = shares[good]
            own, symbol = contexts[keys >> _POINT], keys & _LAST
            good = inside(own, k - 1) & (to[symbol] >= 0)
            grams = (dense(own[good], k - 1) << _BITS) | to[symbol[good]]
            order = np.argsort(grams)
            grams, added = grams[order], values[good][order]
            # One part for each first symbol, so that no array but the last has the full size.
            out = np.empty(_SYMBOLS ** k, np.float32 if k < ORDER else np.float16)
            size = len(lower) if k > 1 else _SYMBOLS
            for start in range(0, len(out), size):
                part = lower * np.repeat(weight[start // _SYMBOLS:(start + size) // _SYMBOLS], _SYMBOLS)
                a, b = np.searchsorted(grams, [start, start + size])
                part[grams[a:b] - start] += added[a:b]
                out[start:start + size] = np.log10(np.maximum(part, 1e-12)) if k == ORDER else part
            lower = out
        return lower


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _symbol_table(letters: list[int]) -> np.ndarray:
    out = np.full(0x110000, _RARE, np.uint8)
    out[letters] = np.arange(2, 2 + len(letters), dtype=np.uint8)
    return out


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts end to end, len + 1 offsets of the texts, and each one's place in its text."""
    data, offsets = flat(texts)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.searchsorted(lead, offsets)
    return points, bounds, np.arange(len(points)) - np.repeat(bounds[:-1], np.diff(bounds))


def _windows(points: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol at the characters ``at``."""
    context = np.zeros(len(at), np.int64)
    for back in range(ORDER - 1, 0, -1):
        before = np.where(place[at] >= back, points[np.maximum(at - back, 0)].astype(np.int64) + 1, _BEFORE)
        context = (context << _POINT) | before
    return context, points[at].astype(np.int64) + 1


def _log_probabilities(texts: pa.Array, model: Model, symbols: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P of each character of the texts end to end, and len + 1 offsets of the texts."""
    points, bounds, place = _code_points(texts)
    own = symbols[points].astype(np.int32)
    grams, other = own.copy(), own == _RARE
    for back in range(1, ORDER):
        earlier = np.zeros_like(own)
        earlier[back:] = own[:-back] if len(own) > back else earlier[back:]
        earlier[place < back] = _BEFORE
        grams |= earlier << (_BITS * back)
        other |= earlier == _RARE
    out = logs[grams].astype(np.float64)
    at = np.flatnonzero(other)
    out[at] = np.log10(np.maximum(model.probability(*_windows(points, place, at)), 1e-12))
    return out, bounds


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as good."""
    return labels.filter(F.col("quality") == 1).select("doc_id").distinct()


def sample_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """All trusted ids, or ``most`` of them, picked by a hash, if a caller asks for a smaller model."""
    ids = trusted_ids(labels)
    return ids if most is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points of the texts, with counts."""
    for piece in pieces(batches, limit=PIECE):
        data, _ = flat(piece.column("text"))
        points, n = np.unique(np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), return_counts=True)
        yield pa.RecordBatch.from_pydict({"point": pa.array(points.astype(np.int32)), "n": pa.array(n.astype(np.int64))})


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each piece of the texts, with counts."""
    for piece in pieces(batches, limit=PIECE):
        points, _, place = _code_points(piece.column("text"))
        context, symbol = _windows(points, place, np.arange(len(points)))
        order = np.lexsort((symbol, context))
        context, symbol = context[order], symbol[order]
        new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])])[:len(symbol)])
        yield pa.RecordBatch.from_pydict({"context": pa.array(context[new]), "symbol": pa.array(symbol[new].astype(np.int32)),
                                          "n": pa.array(np.diff(np.append(new, len(symbol))).astype(np.int64))})


def train(sample: DataFrame) -> Model | None:
    """Fits the model to the four fifths of ``sample`` that are not held out."""
    sample = sample.filter(~_held_out()).select("text")
    found = stored(sample.mapInArrow(_letters, "point int, n bigint").groupBy("point").agg(F.sum("n").alias("n")), "letters")
    known = [r["point"] for r in found.orderBy(F.desc("n"), "point").limit(_SYMBOLS - 2).collect()]
    if not known:
        return None
    size = max(_SYMBOLS, found.count() + 2)  # one for what stands before a text, one for any unseen character
    counts = stored(sample.mapInArrow(_grams, "context bigint, symbol int, n bigint").groupBy("context", "symbol")
                    .agg(F.sum("n").alias("n")), "kn-counts")
    terms, weights = {}, {}
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # how many different symbols stand before
            shorter = F.col("context").bitwiseAND(F.lit((1 << (_POINT * (k - 1))) - 1).cast("long"))
            counts = counts.groupBy(shorter.alias("context"), "symbol").agg(F.count("*").alias("n"))
        of = counts.agg(*[F.sum((F.col("n") == i).cast("int")).alias(f"n{i}") for i in range(1, 5)]).first()
        n1, n2, n3, n4 = (max(x or 0, 1) for x in of)
        y = n1 / (n1 + 2 * n2)
        cut = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        rows = counts.withColumn("off", off)
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        joined = rows.join(contexts, "context").select(
            "context", "symbol", ((F.col("n") - F.col("off")) / F.col("total")).cast("float").alias("p")).toArrow()
        rest = contexts.select("context", (F.col("left") / F.col("total")).cast("float").alias("w")).toArrow()
        order = np.argsort(own := rest["context"].to_numpy())
        weights[k] = own[order], rest["w"].to_numpy()[order]
        keys = (np.searchsorted(weights[k][0], joined["context"].to_numpy()) << _POINT) | joined["symbol"].to_numpy().astype(np.int64)
        order = np.argsort(keys)
        terms[k] = keys[order], joined["p"].to_numpy()[order]
    seed = hash((tuple(known), *(x for t in terms.values() for x in (len(t[0]), float(t[1].sum())))))
    return Model(known, size, weights, terms, str(seed))


def with_log_probability(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("__symbols", "__log")) -> DataFrame:
    """All columns of ``docs``, then ``names``: characters of the text, and their log10 probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        given = shared.value
        if given.name not in _TABLES:
            _TABLES.clear()
            _TABLES[given.name] = _symbol_table(given.letters), given.log_table()
        symbols, logs = _TABLES[given.name]
        for piece in pieces(batches, text, PIECE):
            each, bounds = _log_probabilities(piece.column(text), given, symbols, logs)
            sums = np.concatenate([[0.0], np.cumsum(each)])
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums[bounds[1:]] - sums[bounds[:-1]])],
                [*piece.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{names[0]}` bigint, `{names[1]}` double")


def _limits(texts: DataFrame, quantile: float) -> DataFrame:
    """lang, mean, n, limit of ``texts`` (lang, mean, p): the largest p in the first of the bins that reach the quantile."""
    bins = texts.groupBy("lang", "mean", F.floor(F.log2("p") * BINS).alias("bin")).agg(
        F.count("*").alias("n"), F.max("p").alias("limit"))
    upto, whole = Window.partitionBy("lang").orderBy("bin"), Window.partitionBy("lang")
    ranked = bins.withColumns({"upto": F.sum("n").over(upto), "n": F.sum("n").over(whole)})
    return ranked.filter(F.col("upto") >= F.ceil(F.lit(quantile) * F.col("n"))).groupBy("lang", "mean", "n").agg(
        F.min("limit").alias("limit"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most: int | None = None,
           names: tuple[str, str, str] = ("__perplexity", "__threshold", "__kept")) -> DataFrame:
    """``docs`` with three more columns that the caller names: perplexity (per character), threshold of the language, kept."""
    perplexity, threshold, kept = names
    symbols, log = unused("symbols", docs), unused("log", docs)
    given = docs.select("doc_id", "text", "lang")
    trusted = stored(trusted_ids(labels), "trusted")
    chosen = trusted if most is None else stored(sample_ids(labels, most), "trained")
    ids = F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen  # more are joined, which shuffles the texts once a pass
    model = train(given.join(ids, "doc_id", "left_semi"))
    if model is None:
        return docs.withColumns({perplexity: F.lit(None).cast("double"), threshold: F.lit(None).cast("double"), kept: F.lit(True)})
    # All trusted rows but those of the training, joined by id after scoring, so that no text is shuffled.
    numbers = with_log_probability(given.filter(_held_out()) if most is None else given, model).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "__symbols", "__log")
    left = numbers if most is None else numbers.join(chosen.filter(~_held_out()), "doc_id", "left_anti")
    held = stored(left.join(trusted, "doc_id", "left_semi").drop("doc_id"), "held-out")
    mean = F.sum("__log") / F.greatest(F.sum("__symbols"), F.lit(1))
    overall = held.agg(mean.alias("mean")).first()["mean"]
    overall = -2.0 if overall is None else overall
    per_text = lambda mean, s="__symbols", g="__log": F.pow(
        F.lit(10.0), -(F.col(g) + PRIOR * mean) / (F.col(s) + PRIOR))
    means = stored(held.groupBy("lang").agg(mean.alias("mean")), "means")
    alike = held.join(F.broadcast(means), "lang").select("lang", "mean", per_text(F.col("mean")).alias("p"))
    limits = _limits(alike, quantile).filter(F.col("n") >= LEAST_HELD).collect()  # a row for each language
    every = _limits(held.select(F.lit("").alias("lang"), F.lit(overall).alias("mean"), per_text(F.lit(overall)).alias("p")), quantile).first()
    mean_of, limit_of = F.lit(overall), F.lit(every and every["limit"]).cast("double")
    if limits:
        own = lambda c: F.try_element_at(
            F.create_map(*(F.lit(x) for r in limits for x in (r["lang"], r[c]))), F.coalesce("lang", F.lit("")))
        mean_of, limit_of = F.coalesce(own("mean"), mean_of), F.coalesce(own("limit"), limit_of)
    scored = with_log_probability(docs, model, names=(symbols, log)).withColumn(
        perplexity, per_text(mean_of, symbols, log)).withColumn(threshold, limit_of)
    return scored.withColumn(kept, F.coalesce(F.col(perplexity) <= F.col(threshold), F.lit(True))).drop(symbols, log)
