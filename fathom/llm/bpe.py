"""Byte-level BPE: encoding by a transducer with bounded lookahead, decoding by a state machine over bytes.

Encoding of a word needs only as many bytes beyond a token as its merges can feel. That number follows from the merge
list (``lookaheads``). So a word of any length is encoded with a buffer of constant size: tokens whose lookahead lies
inside the buffer are final and leave it.

Cases: a null text counts as empty and has no tokens; a special token's string in a text is that token; repeated rows
give repeated results; columns of the input beside the two named ones are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import flat, pieces

#: Words whose tokens a worker remembers.
REMEMBERED = 400_000
#: Least bytes of a word that the transducer holds at a time.
BUFFER = 1024
#: Bytes of text that a task encodes at once.
PIECE = 2 << 20
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Endings that form a word of their own after an apostrophe (fixed values of the pattern).
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _byte_letters() -> dict[str, int]:
    """The printable character which stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _classes() -> np.ndarray:
    """Class of each code point: white space, letter, number, other."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = _SPACE
    return out


def lookaheads(merges: list[tuple[int, int, int]], lengths: list[int]) -> list[int]:
    """For each token: how many bytes beyond its end can decide that it is formed there and stays.

    ``merges`` holds (left, right, result) by rank. A merge at a place depends on earlier merges that overlap it: one
    that takes its right part together with what follows (then on all which that one depends on), or one that takes
    its left part together with what stands before. Ranks only fall along such a chain, so one pass in rank order
    over the best chains so far finds the longest.
    """
    n = len(lengths)
    formed, taken_right, taken_left = [0] * n, [0] * n, [0] * n
    for left, right, result in merges:
        need = max(formed[left] - lengths[right], formed[right], taken_right[right], taken_left[left] - lengths[right], 0)
        formed[result] = max(formed[result], need)
        taken_right[left] = max(taken_right[left], lengths[right] + need)
        taken_left[right] = max(taken_left[right], need)
    return [max(x) for x in zip(formed, taken_right, taken_left, strict=True)]


class Transducer:
    """Encoder and decoder for one vocabulary file; one per worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, letters = content["model"]["vocab"], _byte_letters()
        self.tokens: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        self.of_byte = [0] * 256
        for i, token in enumerate(self.tokens):
            if len(token) == 1:
                self.of_byte[token[0]] = i
        merges = []
        for pair in content["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
        self.lookahead = lookaheads(merges, [len(t) for t in self.tokens])
        self.ranks = {left << 32 | right: (rank, result) for rank, (left, right, result) in enumerate(merges)}
        order = np.argsort(np.array([left << 32 | right for left, right, _ in merges], np.int64))
        self.pair_keys = np.array([left << 32 | right for left, right, _ in merges], np.int64)[order]
        self.pair_ranks, self.results = order.astype(np.int64), np.array([x[2] for x in merges], np.int64)
        self.special = {t["content"].encode(): t["id"] for t in content.get("added_tokens", [])}
        for text, i in self.special.items():
            self.tokens += [b""] * (i + 1 - len(self.tokens))
            self.tokens[i] = text
        self.buffer = max(BUFFER, 2 * max(self.lookahead) + 2 * max(map(len, self.tokens)))
        whole = [i for i, t in enumerate(self.tokens) if t and t not in self.special]
        merged = self._merged_all([self.tokens[i] for i in whole])
        self.whole = {self.tokens[i]: ids for i, ids in zip(whole, merged, strict=True) if len(ids) == 4}
        self.known: dict[bytes, bytes] = {}
        self.classes = _classes()

    def _merged(self, data: bytes) -> list[int]:
        """All merges inside ``data``, lowest rank first, leftmost first among equals."""
        ids, get = [self.of_byte[b] for b in data], self.ranks.get
        none = (1 << 60, 0)
        pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none or best[0] == none[0]:
                break
            i = pairs.index(best)
            ids[i:i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | best[1], none)
            if i < len(pairs):
                pairs[i] = get(best[1] << 32 | ids[i + 1], none)
        return ids

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.results))

    def _merged_all(self, words: list[bytes]) -> list[bytes]:
        """``_merged`` for many words side by side: one merge in each unfinished word at a time. Ids take four bytes."""
        out = [b""] * len(words)
        none, who = len(self.results), np.arange(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(len(ids), none)
        ranks[:-1] = self._rank_of(ids[:-1], ids[1:])
        ranks[np.cumsum(sizes) - 1] = none
        while len(who):
            ends = np.cumsum(sizes)
            best = np.minimum.reduceat(ranks, ends - sizes)
            live = best < none
            if not live.all():
                packed, over = ids.astype("<u4").tobytes(), np.flatnonzero(~live)
                for k, low, high in zip(who[over].tolist(), (4 * (ends - sizes)[over]).tolist(), (4 * ends[over]).tolist()):
                    out[k] = packed[low:high]
                stay = np.repeat(live, sizes)
                ids, ranks, who, sizes, best = ids[stay], ranks[stay], who[live], sizes[live], best[live]
                if not len(who):
                    break
            at = np.flatnonzero(ranks == np.repeat(best, sizes))
            word = np.repeat(np.arange(len(who)), sizes)
            owner = word[at]
            at = at[np.concatenate([[True], owner[1:] != owner[:-1]])]
            ids[at] = self.results[best]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, ranks, word = ids[stay], ranks[stay], word[stay]
            sizes = sizes - 1
            at = at - np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                inside = (left + 1 < len(ids)) & (word[np.minimum(left + 1, len(ids) - 1)] == word[left])
                ranks[left[~inside]] = none
                left = left[inside]
                ranks[left] = self._rank_of(ids[left], ids[left + 1])
        return out

    def stream(self, parts: Iterator[bytes]) -> Iterator[int]:
        """Tokens of one word that comes in parts, each as soon as nothing that follows can change it."""
        held = b""
        for part in parts:
            held += part
            while len(held) >= self.buffer:
                window, end = held[:self.buffer], 0
                for token in self._merged(window):
                    upto = end + len(self.tokens[token])
                    if upto + self.lookahead[token] > len(window):
                        break
                    yield token
                    end = upto
                if not end:
                    raise ValueError("the buffer is shorter than the lookahead")
                held = held[end:]
        yield from self._merged(held)

    def words(self, distinct: list[bytes]) -> list[bytes]:
        """Tokens of each word, four bytes each. What fits the buffer is merged whole, longer words stream through it."""
        whole, known = self.whole, self.known
        found = [whole.get(w) or known.get(w) for w in distinct]
        missing = [i for i, x in enumerate(found) if x is None]
        short = [i for i in missing if len(distinct[i]) < self.buffer]
        if len(known) + len(short) > REMEMBERED:
            known.clear()
        for at in range(0, len(short), 10_000):
            group = short[at:at + 10_000]
            for i, ids in zip(group, self._merged_all([distinct[i] for i in group]), strict=True):
                found[i] = ids
                if len(known) < REMEMBERED:
                    known[distinct[i]] = ids
        for i in missing:
            if found[i] is None:
                data = distinct[i]
                parts = (data[k:k + self.buffer] for k in range(0, len(data), self.buffer))
                found[i] = np.fromiter(self.stream(parts), "<u4").tobytes()
        return found

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which words begin, for texts laid end to end. ``offsets`` has their bounds."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind, n = self.classes[points], len(points)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(lead, offsets)] = True
        first_here, last = first[:n], first[1:].copy()
        last[-1] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        begin = change | first_here
        space = kind == _SPACE
        # The last of some white space before a word stands alone; a blank joins the word.
        ends_gap = space & ~last
        ends_gap[:-1] &= ~space[1:]
        ends_gap[-1] = False
        begin |= ends_gap
        blank = ends_gap & (points == 32)
        begin[1:] &= ~blank[:-1]
        # Short endings after an apostrophe that begins a word.
        for i in np.flatnonzero((points == 39) & begin):
            if i and blank[i - 1] and not first_here[i]:
                continue
            upto = i + 1
            while upto < min(n, i + 3) and not first_here[upto] and points[upto] < 128:
                upto += 1
            tail = bytes(points[i + 1:upto].tolist())
            for ending in _ENDINGS:
                if tail.startswith(ending):
                    after = i + 1 + len(ending)
                    begin[i + 1:after] = False
                    begin[after:after + 1] = True
                    break
        return lead[begin]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (unsigned 32 bits), and len + 1 offsets."""
        data, offsets = flat(texts)
        bounds, marks = offsets, []
        if self.special and len(data):
            raw = data.tobytes()
            for text, i in self.special.items():
                at = raw.find(text)
                while at >= 0:
                    k = int(np.searchsorted(offsets, at, "right"))
                    if at + len(text) <= offsets[k]:
                        marks.append((at, at + len(text), i))
                        at = raw.find(text, at + len(text))
                    else:
                        at = raw.find(text, at + 1)
            if marks:
                bounds = np.union1d(offsets, [x for mark in marks for x in mark[:2]])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begin = self.starts(data, bounds)
        for low, high, _ in marks:
            begin = begin[(begin <= low) | (begin >= high)]
        edges = np.append(begin, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = pc.dictionary_encode(parts)
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        ids = self.words(distinct)
        if marks:
            ids = [np.array([self.special[w]], "<u4").tobytes() if w in self.special else x
                   for w, x in zip(distinct, ids, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        begins = np.cumsum(sizes) - sizes
        of_word = sizes[codes]
        ends = np.cumsum(of_word)
        total = int(ends[-1])
        index = np.repeat(begins[codes] - (ends - of_word), of_word)
        index += np.arange(total)
        upto = np.concatenate([[0], ends])
        return pool[index], upto[np.searchsorted(edges[:-1], offsets)]

    def decode(self, ids: Iterator[int] | np.ndarray, step: int = 65_536) -> Iterator[str]:
        """Text of the ids in parts. Bytes of an unfinished character wait for the next part; broken ones give U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        for at in range(0, len(ids), step):
            yield state.decode(b"".join([self.tokens[i] for i in ids[at:at + step]]))
        yield state.decode(b"", True)


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                  with_ids: bool = True) -> DataFrame:
    """Encodes each whole text and decodes the ids again. No shuffle; a task holds a few MB of text at a time.

    Returns doc_id, n_tokens, ids (array of int; only if ``with_ids``), ids_sha256 of the ids as little-endian unsigned
    32-bit integers, and decoded_sha256 of the decoded text.
    """

    def run(batches):
        known = transducer(path or vocabulary_path())
        for piece in pieces(batches, limit=PIECE):
            ids, offsets = known.encode(piece.column("text"))
            digests, texts = [], []
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = ids[low:high]
                digests.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded = hashlib.sha256()
                for part in known.decode(own):
                    decoded.update(part.encode())
                texts.append(decoded.hexdigest())
            columns = {"doc_id": piece.column("doc_id"), "n_tokens": pa.array(np.diff(offsets), pa.int64())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            columns |= {"ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    ids = "ids array<int>, " if with_ids else ""
    return given.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string")
