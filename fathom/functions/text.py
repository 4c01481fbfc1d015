"""Text analysis as native column expressions on one array of tokens per text.

Every step stays inside the row, so analysing a table needs no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.rows import let, prefix_sums, run_starts

# Character classes, written out so that Java and RE2 read them alike (their \w and \s are ASCII only).
WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
# A token runs from the first to the last word character of a stretch without whitespace.
TOKEN = rf"[{WORD}](?:[^{SPACE}]*[{WORD}])?"
# Token first, gap after it: the pieces then tile the text and no run of punctuation is scanned twice.
TOKEN_AND_GAP = rf"({TOKEN})[^{WORD}]*"
LEADING_GAP = rf"^[^{WORD}]*"
NON_WORD = rf"[^{WORD}]+"
# A part ends where lower case turns to upper case, letters to digits or back, or at punctuation.
PART = r"[\p{Lu}\p{Lt}]*[\p{Ll}\p{Lm}\p{Lo}]+|[\p{Lu}\p{Lt}]+|\p{N}+"
PART_AND_GAP = rf"({PART})[^\p{{L}}\p{{N}}]*"
PART_LEADING_GAP = r"^[^\p{L}\p{N}]*"
ONE_PART = rf"^(?:{PART})$"

TOKEN_TYPE = "array<struct<pos:int,start:int,end:int,text:string,kind:string>>"


def _fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and their base letters, from Unicode decomposition."""
    # Letters with a stroke or ligature shape have no decomposition.
    pairs = {"ß": "s", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i"}
    for code in [*range(0x00DF, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if char.islower() and base != char and base.isascii() and base.isalpha():
            pairs[char] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()


def _with_starts(text: Column, pattern: str, leading: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` over the matches of group 1 and their start offsets; ``pattern`` must tile the text after ``leading``."""
    whole, wanted = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1))
    lead = F.length(F.regexp_extract(text, leading, 0))
    return let(wanted, lambda words: let(
        prefix_sums(F.transform(whole, F.length), lead), lambda starts: body(words, starts)))


def _spans(text: Column, pattern: str, leading: str) -> Column:
    """Matches of group 1 with position and character offsets."""
    return _with_starts(text, pattern, leading, lambda words, starts: F.transform(
        words, lambda w, i: _plain_token(i, F.get(starts, i), w)))


def _plain_token(pos: Column, start: Column, text: Column) -> Column:
    return F.struct(
        pos.alias("pos"), start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))


def tokens(text: Column) -> Column:
    """Split at whitespace and strip punctuation around each word; with position and offsets."""
    return _spans(text, TOKEN_AND_GAP, LEADING_GAP)


def tokens_without_offsets(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(TOKEN_AND_GAP), F.lit(1))
    return F.transform(words, lambda w, i: F.struct(
        i.alias("pos"), F.lit(0).alias("start"), F.lit(0).alias("end"), w.alias("text")))


def strip_punct(token: Column) -> Column:
    return F.regexp_replace(token, NON_WORD, "")


def intraword(token: Column) -> Column:
    """Parts of a token, as strings."""
    return F.regexp_extract_all(token, F.lit(PART), F.lit(0))


def _token(pos: Column, start: Column, end: Column, text: Column, kind: str) -> Column:
    return F.struct(
        pos.alias("pos"), start.alias("start"), end.alias("end"), text.alias("text"), F.lit(kind).alias("kind"))


def variants(t: Column, offsets: bool = True) -> Column:
    """The token itself, the token without punctuation, and its parts; all at the same position."""
    original = _token(t["pos"], t["start"], t["end"], t["text"], "original")
    joined = _token(t["pos"], t["start"], t["end"], strip_punct(t["text"]), "joined")
    if offsets:
        parts = F.transform(
            _spans(t["text"], PART_AND_GAP, PART_LEADING_GAP),
            lambda p: _token(t["pos"], t["start"] + p["start"], t["start"] + p["end"], p["text"], "part"))
    else:
        parts = F.transform(intraword(t["text"]), lambda p: _token(t["pos"], t["start"], t["end"], p, "part"))
    return F.concat(F.array(original, joined), parts)


def each_variant(t: Column, offsets: bool = True) -> Column:
    """Variants of one token. One that is a single part, the common case, is its own joined form and part; only others are
    taken apart."""
    itself = F.array(*[_token(t["pos"], t["start"], t["end"], t["text"], kind) for kind in ("original", "joined", "part")])
    return F.when(t["text"].rlike(ONE_PART), itself).otherwise(variants(t, offsets))


def each_new_variant(t: Column, offsets: bool = True) -> Column:
    """Variants of one token that differ in text or offsets (in text alone if there are no offsets). With offsets, variants of
    other tokens can't be equal to them."""
    itself = F.array(_token(t["pos"], t["start"], t["end"], t["text"], "original"))
    return F.when(t["text"].rlike(ONE_PART), itself).otherwise(_new_variants(t, offsets))


def distinct_variants(toks: Column) -> Column:
    """Tokens and variants of a text that is indexed without offsets: the first of those that agree in text, in their order."""
    def first(toks: Column, a: Column) -> Column:
        heads = run_starts(a, lambda x, y: x["text"] == y["text"])
        return F.transform(F.array_sort(F.transform(heads, lambda h: F.get(a, h)["i"])), lambda i: F.get(toks, i))

    several = F.flatten(F.transform(toks, lambda t: each_new_variant(t, False)))
    return let(several, lambda all_: let(F.sort_array(F.transform(all_, lambda t, i: F.struct(
        t["text"].alias("text"), i.alias("i")))), lambda a: first(all_, a)))


def _new_variants(t: Column, offsets: bool = True) -> Column:
    """Variants of one token without repeats: only the joined form or a single part can repeat the token itself."""
    return F.filter(variants(t, offsets), lambda v, i: (i == 0) | (v["text"] != t["text"]) | (v["start"] != t["start"])
                    | (v["end"] != t["end"]))


def fold_accents(term: Column) -> Column:
    return F.translate(term, FOLD_FROM, FOLD_TO)


def normal_term(text: Column) -> Column:
    """Lower case without accents; pure ASCII (as many bytes as characters) needs no folding."""
    lower = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), lower).otherwise(fold_accents(lower))


def _normal(pos: Column, start: Column, end: Column, text: Column, kind: Column) -> Column:
    return F.struct(pos.alias("pos"), start.alias("start"), end.alias("end"), normal_term(text).alias("term"),
                    kind.alias("kind"))


def normal_terms(toks: Column) -> Column:
    """The last steps for a whole token array; offsets stay those of the text."""
    return F.transform(toks, lambda t: _normal(t["pos"], t["start"], t["end"], t["text"], t["kind"]))


def _analysed(words: Column, starts: Column) -> Column:
    """All steps in one pass. A token that is a single part, the common case, has no variant but itself."""
    def one(w: Column, i: Column) -> Column:
        start = F.get(starts, i)
        itself = F.array(_normal(i, start, start + F.length(w), w, F.lit("original")))
        return F.when(w.rlike(ONE_PART), itself).otherwise(
            normal_terms(let(_plain_token(i, start, w), lambda t: _new_variants(t))))

    return F.flatten(F.transform(words, one))


def analyzed(df: DataFrame, col: str, out: str, offsets: bool = True) -> DataFrame:
    """Add ``out``: the analysed tokens of ``col``. ``offsets=False`` is for fields indexed without (titles)."""
    text = F.coalesce(F.col(col), F.lit(""))
    if offsets:
        return df.withColumn(out, _with_starts(text, TOKEN_AND_GAP, LEADING_GAP, _analysed))
    df = df.withColumn(out, distinct_variants(tokens_without_offsets(text)))
    return df.withColumn(out, normal_terms(F.col(out)))


def term_list(df: DataFrame, col: str, out: str, offsets: bool = True) -> DataFrame:
    """Add ``out``: only the terms of :func:`analyzed`, repeats included, where positions are not needed."""
    if not offsets:
        return analyzed(df, col, out, offsets).withColumn(out, F.transform(out, lambda t: t["term"]))

    def one(w: Column) -> Column:
        # Offsets inside the token tell its variants apart as well as offsets in the text.
        several = let(_plain_token(F.lit(0), F.lit(0), w), lambda t: _new_variants(t))
        return F.when(w.rlike(ONE_PART), F.array(normal_term(w))).otherwise(
            F.transform(several, lambda v: normal_term(v["text"])))

    words = F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(TOKEN_AND_GAP), F.lit(1))
    return df.withColumn(out, F.flatten(F.transform(words, one)))


def occurrences(toks: Column) -> Column:
    """Group one text's analysed tokens by term: ``array<struct<term,tf,positions,offsets>>``.

    Sorting and cutting runs inside the row replaces a shuffle on (term, document).
    """
    ordered = F.sort_array(F.transform(toks, lambda t: F.struct(
        t["term"].alias("term"), t["pos"].alias("pos"), t["start"].alias("start"), t["end"].alias("end"))))

    def cut(a: Column, heads: Column) -> Column:
        def one(h: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(heads, k + 1), F.size(a))
            return let(F.slice(a, h + 1, stop - h), lambda run: F.struct(
                F.get(a, h)["term"].alias("term"),
                F.size(run).alias("tf"),
                run["pos"].alias("positions"),
                F.transform(run, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("offsets")))
        return F.transform(heads, one)

    return let(ordered, lambda a: let(
        run_starts(a, lambda x, y: x["term"] == y["term"]), lambda heads: cut(a, heads)))


def frequencies(terms: Column) -> Column:
    """One text's terms (array of strings) counted: ``array<struct<term,tf>>``."""
    def cut(a: Column, heads: Column) -> Column:
        return F.transform(heads, lambda h, k: F.struct(
            F.get(a, h).alias("term"), (F.coalesce(F.get(heads, k + 1), F.size(a)) - h).alias("tf")))

    return let(F.sort_array(terms), lambda a: let(run_starts(a, lambda x, y: x == y), lambda heads: cut(a, heads)))


def wildcard_regex(pattern: Column) -> Column:
    """``*`` and ``?`` of a pattern as a regular expression; everything else literal."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")),
                    F.lit(")$"))
