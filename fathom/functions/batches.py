"""Text analysis of whole Arrow batches inside a task: the tokens of :mod:`fathom.functions.text` for tables of texts.

The class of every character is looked up at once, distinct tokens are taken apart once, and all else is arithmetic on flat
arrays. Column expressions, which visit each token of each text one by one, remain for short tables such as queries. Letters
and numbers are those of Python's Unicode tables; the column expressions use Java's.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathom.functions.text import FOLD_FROM, FOLD_TO

#: Bytes of text that are turned into flat arrays at once; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Distinct tokens that a worker remembers.
REMEMBERED = 200_000
OFFSETS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

_WORD, _SPACE = 1, 2
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
# A token's characters as classes: upper case, other letters, numbers, the underscore, all else.
_PART = re.compile("U*l+|U+|N+")


class _Classes(dict):
    def __missing__(self, point: int) -> str:
        kind = unicodedata.category(chr(point))
        self[point] = "U" if kind in ("Lu", "Lt") else "l" if kind[0] == "L" else "N" if kind[0] == "N" else "_" if point == 0x5F else " "
        return self[point]


_CLASS = _Classes()


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Word character, white space or neither, by code point."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            out[point] = _WORD
        elif kind == "Z":
            out[point] = _SPACE
    out[0x5F] = _WORD
    out[[*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85]] = _SPACE
    return out


def normal_term(text: str) -> str:
    lower = text.lower()
    return lower if text.isascii() else lower.translate(_FOLD)


def _variants(word: str) -> list[tuple[str, str, int, int, bool]]:
    """text, term, start, end and whether it is a part, of a token and its variants that differ from it, by offsets."""
    classes = word.translate(_CLASS)
    itself = (word, normal_term(word), 0, len(word), False)
    if _PART.fullmatch(classes):
        return [itself]
    out = [itself]
    joined = "".join(c for c, k in zip(word, classes) if k != " ")
    if joined != word:
        out.append((joined, normal_term(joined), 0, len(word), False))
    for m in _PART.finditer(classes):
        if m.end() - m.start() < len(word):
            text = word[m.start():m.end()]
            out.append((text, normal_term(text), m.start(), m.end(), True))
    return out


_SEEN: dict[str, list[tuple[str, str, int, int, bool]]] = {}


@dataclass
class Tokens:
    """Tokens and variants of texts, by text, place and offsets: ``code`` is the place of the term in the sorted ``terms``."""

    doc: np.ndarray
    pos: np.ndarray
    start: np.ndarray
    end: np.ndarray
    part: np.ndarray
    code: np.ndarray
    terms: list[str]
    lengths: np.ndarray  # of the texts, variants counted

    def of(self, wanted: np.ndarray) -> Tokens:
        return replace(self, **{n: getattr(self, n)[wanted] for n in ("doc", "pos", "start", "end", "part", "code")})


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len + 1 offsets. A null text is empty."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, code points, the len + 1 places of the code points' bytes, and the len + 1 offsets of the texts in code points."""
    data, offsets = _flat(texts)
    if not (data & 0x80).any():
        return data, data, np.arange(len(data) + 1), offsets
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # as a Java string has it
        return _points(pa.array([t.decode("utf-8", "replace") for t in pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()], pa.large_string()))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return data, np.frombuffer(text.encode("utf-32-le"), np.uint32), np.append(lead, len(data)), np.searchsorted(lead, offsets)


def analyzed(texts: pa.Array, offsets: bool = True) -> Tokens:
    """The analysed tokens of texts; without ``offsets`` only the first of those of a text that agree, as for titles."""
    data, points, at, bounds = _points(texts)
    kinds = _kinds()[points]
    word = np.flatnonzero(kinds == _WORD)
    broken = (kinds == _SPACE).astype(np.int64)
    inner = bounds[1:-1]
    np.add.at(broken, inner[inner < len(broken)], 1)
    stretch = np.cumsum(broken)[word]
    new = stretch[1:] != stretch[:-1]
    edge = np.ones(min(len(word), 1), bool)
    starts, ends = word[np.concatenate([edge, new])], word[np.concatenate([new, edge])] + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    pos = np.arange(len(starts)) - np.searchsorted(doc, np.arange(len(bounds) - 1))[doc]

    first, size = at[starts], at[ends] - at[starts]
    upto = np.concatenate([[0], np.cumsum(size)])
    own = data[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(own)).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False)
    if len(_SEEN) > REMEMBERED:
        _SEEN.clear()
    n, rows = [], []
    for w in coded.dictionary.to_pylist():
        found = _SEEN.get(w)
        if found is None:
            found = _SEEN[w] = _variants(w)
        n.append(len(found))
        rows += sorted(found, key=lambda v: v[2:4]) if offsets and len(found) > 1 else found
    text_of, term_of, from_, to, part = zip(*rows) if rows else ((),) * 5
    terms = sorted(set(term_of))
    place = {t: i for i, t in enumerate(terms)}
    code = np.fromiter((place[t] for t in term_of), np.int64, len(rows))

    # From distinct tokens back to all of them.
    n = np.array(n, np.int64)
    each = n[words]
    token = np.repeat(np.arange(len(words)), each)
    row = (np.cumsum(n) - n)[words][token] + np.arange(len(token)) - (np.cumsum(each) - each)[token]
    own_doc, count = doc[token], len(bounds) - 1
    if not offsets:
        texts_at = {t: i for i, t in enumerate(dict.fromkeys(text_of))}
        same = np.fromiter((texts_at[t] for t in text_of), np.int64, len(rows))
        _, kept = np.unique(own_doc * max(len(texts_at), 1) + same[row], return_index=True)
        kept.sort()
        token, row, own_doc = token[kept], row[kept], own_doc[kept]
        start = end = np.zeros(len(row), np.int64)
    else:
        base = (starts - bounds[doc])[token]
        start, end = base + np.array(from_, np.int64)[row], base + np.array(to, np.int64)[row]
    return Tokens(own_doc, pos[token], start, end, np.array(part, bool)[row], code[row], terms, np.bincount(own_doc, minlength=count))


def wanted_terms(terms: list[str], only: frozenset[str] | None, like: re.Pattern | None = None) -> np.ndarray | None:
    """Which terms are asked for; nothing if all are."""
    if only is None:
        return None
    return np.fromiter((t in only or like is not None and like.fullmatch(t) is not None for t in terms), bool, len(terms))


def pattern_of(patterns: list[str]) -> re.Pattern | None:
    """``*`` and ``?`` of patterns as one regular expression; everything else literal."""
    each = ("".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in p) for p in patterns)
    return re.compile("|".join(f"(?:{p})" for p in each), re.DOTALL) if patterns else None


@dataclass
class Groups:
    """Terms of texts, each with its number, places and offsets; ``heads`` are len + 1 bounds of its places."""

    doc: np.ndarray
    code: np.ndarray
    heads: np.ndarray
    pos: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def tf(self) -> np.ndarray:
        return np.diff(self.heads)


def grouped(t: Tokens) -> Groups:
    key = t.doc * max(len(t.terms), 1) + t.code
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return Groups(t.doc[order][heads], t.code[order][heads], np.append(heads, len(key)), t.pos[order], t.start[order], t.end[order])


def columns(g: Groups, terms: list[str], positions: bool) -> dict[str, pa.Array]:
    """term, tf and, if asked for, positions and offsets."""
    int32 = lambda a: pa.array(a.astype(np.int32))
    out = {"term": pa.array(terms, pa.string()).take(pa.array(g.code)), "tf": int32(g.tf)}
    if positions:
        bounds = int32(g.heads)
        out |= {"positions": pa.ListArray.from_arrays(bounds, int32(g.pos)),
                "offsets": pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([int32(g.start), int32(g.end)], fields=list(OFFSETS.value_type)))}
    return out


def most_frequent(g: Groups, n_terms: int) -> np.ndarray:
    """A mark for the most frequent term of each text, the last of equals."""
    weight = g.tf * max(n_terms, 1) + g.code
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(g.doc), 1), bool), g.doc[1:] != g.doc[:-1]]))
    return weight == np.repeat(np.maximum.reduceat(weight, heads), np.diff(np.append(heads, len(weight)))) if len(weight) else np.zeros(0, bool)


def pieces(batches: Iterator[pa.RecordBatch], texts: list[str], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into pieces with at most ``limit`` bytes in the columns ``texts``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
        ends = np.cumsum(size) if texts else np.zeros(batch.num_rows, np.int64)
        at, base = 0, 0
        while at < batch.num_rows:
            upto = max(int(np.searchsorted(ends, base + limit, "right")), at + 1)
            yield batch.slice(at, upto - at)
            at, base = upto, int(ends[upto - 1])
