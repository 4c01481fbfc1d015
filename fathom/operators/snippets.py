"""Highlighted fragments around matches, computed inside the row of a hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fathom.functions import batches as batch_text
from fathom.functions.rows import let, run_starts

TOKENS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("pos", "start", "end")] + [StructField(n, StringType()) for n in ("term", "kind")]))
SURROUND, MAX_CHARS, TOP, FALLBACK_CHARS = 25, 200, 3, 170


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _phrase_only(toks: Column, words: Column) -> Column:
    """Tokens that take part in an occurrence of ``words`` (in order) at consecutive positions."""
    def starts_of(w: Column, i: Column) -> Column:
        return F.transform(F.filter(toks, lambda t: t["term"] == w), lambda t: t["pos"] - i)

    first = starts_of(F.get(words, F.lit(0)), F.lit(0))
    starts = F.filter(
        F.array_distinct(first),
        lambda s: F.forall(F.transform(words, starts_of), lambda places: F.array_contains(places, s)))
    return let(starts, lambda at: F.filter(toks, lambda t: F.exists(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: (x["w"] == t["term"]) & F.array_contains(at, t["pos"] - x["i"]))))


def matched_spans(toks: Column, words: Column, strict_phrase: bool = False) -> Column:
    """Spans of the matching tokens ``toks`` in text order, without overlaps: a whole token hides its parts."""
    def widest(a: Column) -> Column:
        heads = run_starts(a, lambda x, y: x["pos"] == y["pos"])

        def one(hs: Column) -> Column:
            def cut(h: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(hs, k + 1), F.size(a))
                return F.slice(a, h + 1, F.when(F.get(a, h)["part"] == 0, 1).otherwise(stop - h))
            return F.flatten(F.transform(hs, cut))

        return let(heads, one)

    if strict_phrase:
        toks = let(toks, lambda f: _phrase_only(f, words))
    keyed = F.sort_array(F.transform(toks, lambda t: F.struct(
        t["pos"].alias("pos"), (t["kind"] == "part").cast("int").alias("part"), t["start"].alias("start"),
        t["end"].alias("end"), t["term"].alias("term"))))
    return let(keyed, widest)


def _cut_long(run: Column, max_chars: int) -> Column:
    """Cut a run of close matches into stretches of ``max_chars``, counted from its first match."""
    head = F.get(run, F.lit(0))["start"]
    heads = run_starts(run, lambda x, y: F.floor((x["start"] - head) / max_chars) == F.floor(
        (y["start"] - head) / max_chars))
    return let(heads, lambda hs: F.transform(hs, lambda h, k: F.slice(
        run, h + 1, F.coalesce(F.get(hs, k + 1), F.size(run)) - h)))


def fragments(spans: Column, size: Column, surround: int = SURROUND, max_chars: int = MAX_CHARS) -> Column:
    """Groups of matches whose surroundings meet, as ``array<array<span>>``; each span knows its left and right pad."""
    def padded(a: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            before = m["start"] - F.get(a, i - 1)["end"]
            after = F.get(a, i + 1)["start"] - m["end"]
            left = F.when(i == 0, m["start"]).otherwise(F.floor(before / 2).cast("int"))
            right = F.when(i == F.size(a) - 1, size - m["end"]).otherwise(after - F.floor(after / 2).cast("int"))
            return F.struct(
                m["start"].alias("start"), m["end"].alias("end"), m["term"].alias("term"),
                F.when(i == 0, F.lit(0)).otherwise(before).alias("before"),
                F.least(F.lit(surround), left).alias("left"), F.least(F.lit(surround), right).alias("right"))
        return F.transform(a, one)

    def grouped(a: Column) -> Column:
        heads = run_starts(a, lambda x, y: x["before"] <= 2 * surround)
        return let(heads, lambda hs: F.flatten(F.transform(hs, lambda h, k: let(
            F.slice(a, h + 1, F.coalesce(F.get(hs, k + 1), F.size(a)) - h), lambda run: _cut_long(run, max_chars)))))

    return let(spans, lambda m: let(padded(m), grouped))


def best_fragments(frags: Column, top: int = TOP) -> Column:
    """The ``top`` fragments with most matches times different terms, in text order."""
    def scored(f: Column) -> Column:
        return F.struct(
            (-F.size(f) * F.size(F.array_distinct(f["term"]))).alias("rank"),
            F.get(f, F.lit(0))["start"].alias("start"), f.alias("f"))

    best = F.slice(F.sort_array(F.transform(frags, scored)), 1, top)
    return F.transform(F.sort_array(F.transform(best, lambda b: F.struct(
        b["start"].alias("start"), b["f"].alias("f")))), lambda b: b["f"])


def mark_and_escape(content: Column, frag: Column, tag: str = "strong") -> Column:
    """Text of one fragment, HTML-escaped once, matches wrapped in a tag."""
    def piece(m: Column, i: Column) -> Column:
        begin = F.when(i == 0, m["start"] - m["left"]).otherwise(F.get(frag, i - 1)["end"])
        return F.concat(
            escape_html(F.substring(content, begin + 1, m["start"] - begin)), F.lit(f"<{tag}>"),
            escape_html(F.substring(content, m["start"] + 1, m["end"] - m["start"])), F.lit(f"</{tag}>"))

    last = F.element_at(frag, -1)
    tail = escape_html(F.substring(content, last["end"] + 1, last["right"]))
    return F.concat(F.array_join(F.transform(frag, piece), ""), tail)


def _of_sequences(toks: Column, sequences: Column) -> Column:
    """Tokens that take part in a whole occurrence of one of ``sequences``; a single term is a sequence of one."""
    return F.array_distinct(F.flatten(F.transform(sequences, lambda s: F.when(
        F.size(s) == 1, F.filter(toks, lambda t: t["term"] == F.get(s, F.lit(0)))).otherwise(_phrase_only(toks, s)))))


def _matching(df: DataFrame, content: str, words: Column, out: str) -> DataFrame:
    """Add ``out``: those analysed tokens of ``content`` whose terms are in the row's own ``words``."""
    df = df.drop(out).withColumn("__terms", words)

    def run(batches):
        for piece in batch_text.pieces(batches, [content]):
            toks, asked = batch_text.analyzed(piece.column(content)), piece.column("__terms")
            place = {t: i for i, t in enumerate(toks.terms)}
            code = np.array([place.get(w, -1) for w in asked.flatten().to_pylist()], np.int64)
            key = pc.list_parent_indices(asked).to_numpy(zero_copy_only=False) * len(place) + code
            t = toks.of(np.isin(toks.doc * len(place) + toks.code, key[code >= 0]))
            bounds = pa.array(np.searchsorted(t.doc, np.arange(piece.num_rows + 1)).astype(np.int32))
            parts = [pa.array(a.astype(np.int32)) for a in (t.pos, t.start, t.end)]
            parts += [pa.array(toks.terms, pa.string()).take(pa.array(t.code)), pa.array(["original", "part"]).take(pa.array(t.part.astype(np.int8)))]
            found = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(parts, ["pos", "start", "end", "term", "kind"]))
            yield pa.RecordBatch.from_arrays([*piece.columns, found], [*piece.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, TOKENS)])).drop("__terms")


def with_fragments(df: DataFrame, content: str, words: str, out: str, surround: int = SURROUND,
                   max_chars: int = MAX_CHARS, strict_phrase: bool = False, sequences: bool = False) -> DataFrame:
    """Add ``out``: the fragments of ``content`` around the terms in the array ``words``.

    With ``sequences`` that is an array of arrays, each a term or the terms of a phrase, which count only together.
    """
    df = _matching(df, content, F.flatten(words) if sequences else F.col(words), out)
    if sequences:
        df = df.withColumn(out, let(F.col(out), lambda toks: _of_sequences(toks, F.col(words))))
    df = df.withColumn(out, matched_spans(F.col(out), F.col(words), strict_phrase))
    return df.withColumn(out, fragments(F.col(out), F.length(content), surround, max_chars))


def with_snippet(df: DataFrame, content: str, words: str, out: str, top: int = TOP, between: str = "...",
                 **options) -> DataFrame:
    """Add ``out``: the best fragments, marked and escaped; empty without a match."""
    df = with_fragments(df, content, words, out, **options)
    df = df.withColumn(out, best_fragments(F.col(out), top))
    return df.withColumn(out, F.array_join(F.transform(
        out, lambda f: mark_and_escape(F.col(content), f)), between))


def spans_of_postings(places: Column) -> Column:
    """Spans of matching tokens from what an index stores of them (``array<struct<pos,start,end,term>>``), as of
    :func:`matched_spans`: a whole token holds its parts, so it stands first among those of its place and hides them."""
    def widest(a: Column) -> Column:
        def one(heads: Column) -> Column:
            def cut(h: Column, k: Column) -> Column:
                run = F.slice(a, h + 1, F.coalesce(F.get(heads, k + 1), F.size(a)) - h)
                first = F.get(a, h)
                return F.when(F.forall(run, lambda x: x["end"] <= first["end"]), F.slice(run, 1, 1)).otherwise(run)
            return F.flatten(F.transform(heads, cut))

        return let(run_starts(a, lambda x, y: x["pos"] == y["pos"]), one)

    ordered = F.sort_array(F.transform(places, lambda p: F.struct(
        p["pos"].alias("pos"), p["start"].alias("start"), (-p["end"]).alias("back"), p["end"].alias("end"), p["term"].alias("term"))))
    return let(ordered, widest)


def with_snippet_of(df: DataFrame, content: str, places: str, out: str, top: int = TOP, between: str = "...",
                    surround: int = SURROUND, max_chars: int = MAX_CHARS) -> DataFrame:
    """Like :func:`with_snippet`, from stored places of the terms; the text is not analysed again."""
    df = df.withColumn(out, spans_of_postings(F.col(places)))
    df = df.withColumn(out, best_fragments(fragments(F.col(out), F.length(content), surround, max_chars), top))
    return df.withColumn(out, F.array_join(F.transform(out, lambda f: mark_and_escape(F.col(content), f)), between))


def snippet_or_fallback(found: Column, description: Column, content: Column) -> Column:
    """The snippet, else the description, else the start of the text."""
    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return F.coalesce(filled(found), filled(description), F.substring(content, 1, FALLBACK_CHARS), F.lit(""))
