"""Secret scan: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags each token of a line as begin, inside or outside of a secret. It sees the token's shape (length, share of
share of
digits, case, hexadecimal or not), the kinds of itself, of the two tokens before and of the one after (keyword, quote, sign, number,
word, ...), whether it touches the token before, and how many digits and signs the whole text has. It is trained on
windows of at most ``TRAIN_DOCS`` texts, half of them with pattern matches, which serve as labels. Trained on these alone it
would only repeat the patterns. So each match is also shown with its evidence taken away: another keyword or none, another
sign between, and an invented value of other letters and length, which no pattern finds; and the same surroundings with an
ordinary word or number in the value's place, which is no secret. Training maximises the conditional likelihood. Decoding is by Viterbi, for many lines side by side. A line in which no token could gain from
being inside a secret is all outside, which is exact, so it is not decoded.

The patterns' spans always stay; a span of the field is added if it touches none of them and has ``SHORTEST`` characters.

Cases: null and empty texts have no spans; repeated rows give repeated results; without any match in the table there is
nothing to learn from and only the patterns count; a null id is scanned but never trained on; further columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import LOWER, flat, mixed, multipliers, pieces, stored

TRAIN_DOCS = 1000
WINDOWS_OF_TEXT = 4
AROUND = 24
STEPS = 150
SHORTEST = 6
#: Fixed patterns by kind, in the order in which kinds are listed; the least length is of group 2 or of the match.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 24),
}
KINDS = [*PATTERNS, "crf"]
#: What stands before invented values, and between it and them; and the alphabets of their stretches.
HINTS = ("pwd", "passphrase", "auth", "bearer", "credential", "key", "login with", "use", "")
BETWEEN = (" ", ": ", " = ", " is ", " => ", ":", "=", " '", ' "')
ALPHABETS = ("ABCDEF0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
ALTERED_OF_TEXT = 4
#: Characters around an altered match that are kept.
EXCERPT = 200
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEYWORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential")

_B = np.arange(256)
_DIGIT, _UPPER = (_B >= 48) & (_B <= 57), (_B >= 65) & (_B <= 90)
_LOWERCASE, _HIGH = (_B >= 97) & (_B <= 122), _B >= 128
_HEX = _DIGIT | ((_B >= 97) & (_B <= 102))
_CLASS = np.where(_B <= 32, 0, np.where(_DIGIT | _UPPER | _LOWERCASE | _HIGH | (_B == 95), 1, 2)).astype(np.uint8)
_PLACE = multipliers(32, 21)
_SHAPES = 9 * 5 * 5 * 2 + 256
_BEGIN_LINE, _WORD, _OTHER_WORD, _NUMBER, _LONG, _KEYWORD, _QUOTE, _COLON, _EQUALS, _SIGN = range(10)
#: Number of values of each feature: shape, kind, kind before, kind two before, kind after, touches, text.
_SIZES = (_SHAPES, 10, 10, 10, 10, 2, 9)
_AT = np.concatenate([[0], np.cumsum(_SIZES)])
_TOUCHES = 5
_O, _Bg, _I = 0, 1, 2
_NEVER = -1e9


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        pattern, least = PATTERNS["assign"]
        found += [("assign", m.start(), m.end()) for m in pattern.finditer(text) if len(m[2]) >= least]
    if "AKIA" in text:
        pattern, least = PATTERNS["access"]
        found += [("access", m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    found += [("hex", m.start(), m.end()) for m in PATTERNS["hex"][0].finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _word_key(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each token's bytes (tokens over 32 bytes are no keyword: 0)."""
    place = np.arange(len(lowered)) - np.repeat(starts, np.diff(np.append(starts, len(lowered))))
    value = (lowered.astype(np.uint64) + np.uint64(1)) * _PLACE[np.minimum(place, 31)]
    value[place >= np.repeat(ends - starts, np.diff(np.append(starts, len(lowered))))] = 0
    return np.where(ends - starts <= 32, mixed(np.add.reduceat(value, starts)), 0)


def _keyword_keys() -> np.ndarray:
    data = np.frombuffer("".join(_KEYWORDS).encode(), np.uint8)
    ends = np.cumsum([len(k) for k in _KEYWORDS])
    return _word_key(data, ends - [len(k) for k in _KEYWORDS], ends)


@dataclass
class Tokens:
    starts: np.ndarray  # bytes
    ends: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    features: np.ndarray  # a column for each feature, shifted into one numbering


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens | None:
    """Tokens of texts laid end to end: runs of letters, digits and "_", and runs of signs."""
    if not len(data):
        return None
    kind = _CLASS[data]
    cut = np.ones(len(data), bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    all_cuts = np.flatnonzero(cut)
    starts = all_cuts[kind[all_cuts] > 0]
    if not len(starts):
        return None
    ends = np.append(all_cuts, len(data))[np.searchsorted(all_cuts, starts, "right")]
    doc = np.searchsorted(offsets, starts, "right") - 1
    line = np.searchsorted(np.flatnonzero(data == 10), starts) + doc
    # White space after a token adds nothing to these sums; only the first token's start may have some before it.
    count = lambda table: np.add.reduceat(table[data], starts, dtype=np.int32)
    digits, upper, lower, high, hexa = map(count, (_DIGIT, _UPPER, _LOWERCASE, _HIGH, _HEX))
    size, sign = ends - starts, kind[starts] == 2
    length = np.searchsorted([2, 3, 6, 10, 16, 20, 24, 32], size, "right")
    share = np.where(digits == 0, 0, np.where(digits == size, 4, 1 + np.searchsorted([0.25, 0.6], digits / size, "right")))
    case = np.where(high > 0, 4, np.where((upper > 0) & (lower > 0), 3, np.where(upper > 0, 2, np.where(lower > 0, 1, 0))))
    shape = np.where(sign, 450 + data[starts].astype(np.int64), ((length * 5 + share) * 5 + case) * 2 + (hexa == size))
    own = np.where(digits == size, _NUMBER, np.where((size >= 16) & (digits > 0), _LONG, np.where(upper + digits == 0, _WORD, _OTHER_WORD)))
    first = data[starts]
    own = np.where(sign, np.where((first == 34) | (first == 39), _QUOTE, np.where(first == 58, _COLON, np.where(first == 61, _EQUALS, _SIGN))), own)
    own[np.isin(_word_key(LOWER[data[starts[0]:]], starts - starts[0], ends - starts[0]), _keyword_keys()) & ~sign] = _KEYWORD

    def beside(step: int) -> np.ndarray:
        out = np.full(len(own), _BEGIN_LINE)
        if step > 0:
            same = line[step:] == line[:-step]
            out[step:][same] = own[:-step][same]
        else:
            same = line[:step] == line[-step:]
            out[:step][same] = own[-step:][same]
        return out

    touches = np.concatenate([[False], starts[1:] == ends[:-1]]) & (beside(1) != _BEGIN_LINE)
    m = len(offsets) - 1
    of_text = np.maximum(np.bincount(doc, size, m), 1)
    level = lambda x: np.searchsorted([0.01, 0.05], np.bincount(doc, x, m) / of_text, "right")
    text = (level(digits) * 3 + level(np.where(sign, size, 0)))[doc]
    columns = [shape, own, beside(1), beside(2), beside(-1), touches.astype(np.int64), text]
    return Tokens(starts, ends, doc, line, np.stack([c + a for c, a in zip(columns, _AT[:-1])], 1))


@dataclass
class Field:
    """Weights: of each feature for the three tags, of tag pairs, of the first tag."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.emit[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out = out + self.emit[features[:, k]]
        # No secret has a gap: a token is inside only if it touches the one before.
        out[features[:, _TOUCHES] == _AT[_TOUCHES], _I] += _NEVER
        return out

    def viterbi(self, emissions: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best tags of the lines given by ``starts`` and ``sizes``; other tokens are outside."""
        tags = np.zeros(len(emissions), np.int8)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        score = emissions[starts] + self.first
        back, alive = [], len(starts)
        for t in range(1, int(sizes[0])):
            alive = int(np.searchsorted(-sizes, -t, "left"))  # lines longer than t
            options = score[:alive, :, None] + self.move[None]
            best = options.argmax(1)
            back.append(best.astype(np.int8))
            score[:alive] = np.take_along_axis(options, best[:, None, :], 1)[:, 0] + emissions[starts[:alive] + t]
        now = score.argmax(1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-sizes, -t, "left"))
            tags[starts[:alive] + t] = now[:alive]
            if t:
                now[:alive] = back[t - 1][np.arange(alive), now[:alive]]
        return tags

    def tags(self, found: Tokens) -> np.ndarray:
        emissions = self.emissions(found.features)
        into = max(self.move[:, 1:].max() - self.move[_O, _O], self.first[1:].max() - self.first[_O], 0)
        gain = emissions[:, 1:].max(1) - emissions[:, 0] + into + max(self.move[1:, _O].max() - self.move[_O, _O], 0)
        starts = np.flatnonzero(np.concatenate([[True], found.line[1:] != found.line[:-1]]))
        sizes = np.diff(np.append(starts, len(gain)))
        hopeful = np.maximum.reduceat(gain, starts) > 0
        if not hopeful.any():
            return np.zeros(len(gain), np.int8)
        return self.viterbi(emissions, starts[hopeful], sizes[hopeful])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(features: np.ndarray, tags: np.ndarray, sizes: np.ndarray, steps: int = STEPS, penalty: float = 1e-5) -> Field:
    """Maximises the conditional log-likelihood of windows laid end to end (adaptive gradient steps)."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    longest, windows = int(sizes[0]), len(sizes)
    alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest)]
    allowed = np.zeros((3, 3))
    allowed[_O, _I] = _NEVER
    field = Field(np.zeros((_AT[-1], 3)), np.zeros((3, 3)), np.zeros(3))
    parts = (field.emit, field.move, field.first)
    memory = [np.full(p.shape, 1e-8) for p in parts]
    truth_emit = np.zeros_like(field.emit)
    hot = np.eye(3)[tags]
    for k in range(features.shape[1]):
        np.add.at(truth_emit, features[:, k], hot)
    truth_move, truth_first = np.zeros((3, 3)), hot[starts].sum(0)
    for t in range(1, longest):
        np.add.at(truth_move, (tags[starts[:alive[t]] + t - 1], tags[starts[:alive[t]] + t]), 1)
    begin = np.array([0, 0, _NEVER])
    for _ in range(steps):
        scores, move = field.emissions(features), field.move + allowed
        ahead = np.zeros((len(scores), 3))
        ahead[starts] = scores[starts] + field.first + begin
        for t in range(1, longest):
            at = starts[:alive[t]] + t
            ahead[at] = _log_sum(ahead[at - 1][:, :, None] + move[None], 1) + scores[at]
        behind = np.zeros((len(scores), 3))
        last = starts + sizes - 1
        total = np.zeros(len(scores))
        norm = _log_sum(ahead[last], 1)
        total[np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes)])] = np.repeat(norm, sizes)
        pairs = np.zeros((3, 3))
        for t in range(longest - 1, 0, -1):
            at = starts[:alive[t]] + t
            inner = move[None] + (scores[at] + behind[at])[:, None, :]
            behind[at - 1] = _log_sum(inner, 2)
            pairs += np.exp(ahead[at - 1][:, :, None] + inner - total[at][:, None, None]).sum(0)
        expected = np.exp(ahead + behind - total[:, None])
        emit = np.stack([sum(np.bincount(features[:, k], expected[:, s], _AT[-1]) for k in range(features.shape[1])) for s in range(3)], 1)
        slopes = (truth_emit - emit, truth_move - pairs, truth_first - expected[starts].sum(0))
        for p, slope, m in zip(parts, slopes, memory, strict=True):
            slope = slope / windows - penalty * p
            m += slope ** 2
            p += 0.5 * slope / np.sqrt(m)
    field.move += allowed
    field.first += begin
    return field


def _characters(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Position in code points, inside its text, of each byte position."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return before[at] - before[offsets[doc]]


def _invented(rng: random.Random) -> str:
    """A value as secrets look: one long stretch, or several joined by signs; letters and digits mixed."""
    letters = rng.choice(ALPHABETS)
    parts = rng.choice([1, 1, 1, 2, 3, 4])
    sizes = [rng.randint(16, 40)] if parts == 1 else [rng.randint(5, 14) for _ in range(parts)]
    while True:
        value = rng.choice("-_.").join("".join(rng.choice(letters) for _ in range(n)) for n in sizes)
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            return value


def altered(text: str, seed: str) -> list[tuple[str, int, int]]:
    """Excerpts around the pattern matches of a text without the patterns' evidence: (excerpt, start, end) of an invented
    secret; of an ordinary word in its place the span is empty."""
    rng, out, spans = random.Random(seed), [], pattern_spans(text)
    ends = [0, *[high for _, _, high in spans]]
    outside = " ".join(text[a:max(a, b)] for a, b in zip(ends, [*[low for _, low, _ in spans], len(text)]))
    plain = re.findall(r"[^\W_]+", outside) or ["it"]
    for _, low, high in spans[:ALTERED_OF_TEXT]:
        before, after = text[max(low - EXCERPT, 0):low], text[high:high + EXCERPT]
        for secret in (True, False):
            lead = rng.choice(HINTS) + rng.choice(BETWEEN)
            value = _invented(rng) if secret else rng.choice([rng.choice(plain), str(rng.randint(0, 10 ** rng.randint(1, 8)))])
            start = len(before) + len(lead)
            made = before + lead + value + (lead[-1] if lead[-1] in "'\"" else "") + after
            out.append((made, start, start + len(value) if secret else start))
    return out


def marked_windows(texts: list[str], marked: list[list[tuple[int, int]]], centres: list[int | None],
                   level: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, place, features, tags) of windows around the marked spans of each text, or ``centres``; ``level`` is the text
    feature where it is not the texts' own."""
    data, offsets = flat(pa.array(texts, pa.string()))
    own = tokens(data, offsets)
    if own is None:
        return
    first, last = (_characters(data, offsets, x, own.doc) for x in (own.starts, own.ends))
    tags = np.zeros(len(first), np.int8)
    bounds = np.searchsorted(own.doc, np.arange(len(texts) + 1))
    for doc in range(len(texts)):
        a, b = bounds[doc], bounds[doc + 1]
        marks = []
        for low, high in marked[doc]:
            i, j = a + np.searchsorted(last[a:b], low, "right"), a + np.searchsorted(first[a:b], high, "left")
            if j > i:
                tags[i] = _Bg
                tags[i + 1:j] = _I
                marks.append(i)
        marks = marks[:WINDOWS_OF_TEXT] or list(range(a, b, 4 * AROUND))[:WINDOWS_OF_TEXT]
        if centres[doc] is not None and b > a:
            marks = [min(a + int(np.searchsorted(last[a:b], centres[doc], "right")), b - 1)]
        for i in marks:
            low, high = max(a, i - AROUND), min(b, i + AROUND)
            line = low + np.flatnonzero(own.line[low:high] == own.line[i])
            features = own.features[line].copy()
            if level is not None:
                features[:, -1] = level[doc]
            yield doc, int(i - a), features, tags[line]


def _training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Features, tags and sizes of windows around matches and of the first windows of texts without."""

    def found(batches):
        for piece in pieces(batches):
            hits = [bool(t) and bool(pattern_spans(t)) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "hit": pa.array(hits)})

    given = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL")
    hits = stored(given.mapInArrow(found, "doc_id long, hit boolean"), "hits")
    pick = lambda hit: hits.filter(F.col("hit") == hit).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS // 2)
    chosen = given.join(F.broadcast(pick(True).union(pick(False))), "doc_id", "left_semi")

    def cut(batches):
        for piece in pieces(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            ids = piece.column("doc_id").to_pylist()
            spans = [pattern_spans(t) for t in texts]
            marked = [[(PATTERNS[k][0].match(t, low).start(2) if k == "assign" else low, high) for k, low, high in s] for t, s in zip(texts, spans)]
            rows = [(ids[d], 0, at, f, t) for d, at, f, t in marked_windows(texts, marked, [None] * len(texts))]
            levels = {i: f[0, -1] for i, _, _, f, _ in rows}
            made = [(i, m) for i, t, s in zip(ids, texts, spans) if s and i in levels for m in altered(t, str(i))]
            if made:
                marks = [[(low, high)] if high > low else [] for _, (_, low, high) in made]
                found = marked_windows([m[0] for _, m in made], marks, [m[1] for _, m in made], np.array([levels[i] for i, _ in made]))
                rows += [(made[d][0], d + 1, at, f, t) for d, at, f, t in found]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "made": pa.array([r[1] for r in rows], pa.int64()),
                "at": pa.array([r[2] for r in rows], pa.int64()),
                "features": pa.array([r[3].astype(np.int32).tobytes() for r in rows], pa.binary()),
                "tags": pa.array([r[4].tobytes() for r in rows], pa.binary())})

    rows = chosen.mapInArrow(cut, "doc_id long, made long, at long, features binary, tags binary").orderBy(
        "doc_id", "at", "features", "tags").collect()
    if not any(set(r["tags"]) & {_Bg} for r in rows):
        return None
    features = np.concatenate([np.frombuffer(r["features"], np.int32).reshape(-1, len(_SIZES)) for r in rows]).astype(np.int64)
    tags = np.concatenate([np.frombuffer(r["tags"], np.int8) for r in rows]).astype(np.int64)
    orphan = (tags == _I) & np.concatenate([[True], tags[:-1] == _O])  # a window may start inside a secret
    sizes = np.array([len(r["tags"]) for r in rows])
    orphan[(np.cumsum(sizes) - sizes)] = tags[np.cumsum(sizes) - sizes] == _I
    tags[orphan] = _Bg
    return features, tags, sizes


def trained(docs: DataFrame) -> Field | None:
    windows = _training_windows(docs)
    return None if windows is None else fit(*windows)


def scanned(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans (kind:start:end, code points, end exclusive)."""

    def run(batches):
        for piece in pieces(batches):
            data, offsets = flat(piece.column("text"))
            own = tokens(data, offsets) if field is not None else None
            more: dict[int, list[tuple[str, int, int]]] = {}
            if own is not None:
                tags = field.tags(own)
                heads = np.flatnonzero(tags == _Bg)
                if len(heads):
                    inside = np.append(tags == _I, False)
                    tails = np.flatnonzero(~inside)
                    tails = tails[np.searchsorted(tails, heads, "right")] - 1
                    low = _characters(data, offsets, own.starts[heads], own.doc[heads])
                    high = _characters(data, offsets, own.ends[tails], own.doc[heads])
                    for doc, a, b in zip(own.doc[heads].tolist(), low.tolist(), high.tolist()):
                        if b - a >= SHORTEST:
                            more.setdefault(doc, []).append(("crf", a, b))
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans")}
            for doc, text in enumerate(piece.column("text").to_pylist()):
                base = pattern_spans(text or "")
                extra = [s for s in more.get(doc, ()) if not any(a < s[2] and s[1] < b for _, a, b in base)]
                kinds = [s[0] for s in base]
                for kind in PATTERNS:
                    out[f"n_{kind}"].append(kinds.count(kind))
                out["n_crf"].append(len(extra))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))))
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id")} | {
                k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame) -> DataFrame:
    return scanned(docs, trained(docs))
