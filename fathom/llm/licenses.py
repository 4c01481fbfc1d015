"""Licence scan by a positional index of rare words.

Templates are word sequences with mandatory key phrases: one-line notices and whole short licences. Each has postings (word,
position in the template). Only words that are rare in the corpus count; document frequencies are counted over all texts.
All of these words that stand in a text are looked up; a template is a candidate at a place if several of the same text's
words agree on where it would start, which may lie before the text if the text begins inside the template. It is
accepted if all its key phrases stand inside that place. Votes belong to their text, so the texts beside it do not matter. The base phrases are found the same way: from the places of their rarest
word, by relative position, and counted everywhere.

Everything but the counting of document frequencies (one row per licence word and task) happens where the texts lie.

Cases: null and empty texts have no words and no labels; repeated rows give repeated results; ties between words of equal
frequency go by the word; further columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import LETTERS, pieces, words

#: Base phrases (fixed values) and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label: text of the template, and the key phrases that must stand in it (wording of the public licence notices).
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms",)),
    "cc-by-nc": ("licensed under cc by nc", ("cc by nc",)),
    "cc-by-sa": ("licensed under cc by sa", ("cc by sa",)),
    "gpl-3": ("licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                   "public license as published by the free software foundation",
                   ("free software", "gnu general public license")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ("permission to use copy modify and or distribute this software",)),
    "lgpl": ("gnu lesser general public license", ("lesser general public license",)),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files to deal in the software without restriction",
                  ("permission is hereby granted", "without restriction")),
    "mit-notice": ("released under the mit license", ("mit license",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
        "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license", ("apache license version 2 0", "unless required by applicable law")),
    "bsd-2-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is "
        "and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness", ("provided that the above copyright notice and this permission notice appear in all copies",)),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights to "
        "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted", "sublicense and or sell copies", "substantial portions of the software")),
}
#: Words in more than this share of texts are not looked up (but each template keeps its ``LEAST_RARE`` rarest).
COMMON = 0.02
LEAST_RARE = 3
#: How many of a text's words must agree on a place.
AGREE = 2

_PHRASES = {k: k.split() for k in BASE}
_TEXTS = {label: (text.split(), [p.split() for p in phrases]) for label, (text, phrases) in TEMPLATES.items()}
VOCABULARY = sorted({w for ws in _PHRASES.values() for w in ws} | {w for ws, _ in _TEXTS.values() for w in ws}
                    | {w for _, ps in _TEXTS.values() for p in ps for w in p})


def _licence_words(texts: pa.Array, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word in ``vocabulary``, or -1, and the offsets of the texts' words."""
    codes, distinct, offsets = words(texts, LETTERS)
    found = pc.fill_null(pc.index_in(distinct, value_set=pa.array(vocabulary, distinct.type)), -1).to_numpy(zero_copy_only=False)
    return found[codes] if len(codes) else np.zeros(0, np.int64), offsets


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each licence word stands, and the number of texts."""

    def count(batches):
        total, seen = 0, np.zeros(len(VOCABULARY), np.int64)
        for piece in pieces(batches):
            own, offsets = _licence_words(piece.column("text"), VOCABULARY)
            doc = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
            pairs = np.unique(doc[own >= 0] * len(VOCABULARY) + own[own >= 0])
            seen += np.bincount(pairs % len(VOCABULARY), minlength=len(VOCABULARY))
            total += piece.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array([*VOCABULARY, None], pa.string()), "n": pa.array([*seen.tolist(), total], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: n.get(w, 0) for w in VOCABULARY}, n.get(None, 0)


@dataclass
class Index:
    """Words by rising document frequency; a smaller number is a rarer word."""

    order: list[str]
    weight: np.ndarray
    posting_word: np.ndarray
    posting_template: np.ndarray
    posting_place: np.ndarray

    @classmethod
    def of(cls, frequencies: dict[str, int], total: int) -> Index:
        order = sorted(frequencies, key=lambda w: (frequencies[w], w))
        number = {w: i for i, w in enumerate(order)}
        postings = []
        for t, (text, _) in enumerate(_TEXTS.values()):
            ranked = sorted({number[w] for w in text})
            rare = {i for k, i in enumerate(ranked) if k < LEAST_RARE or frequencies[order[i]] <= COMMON * total}
            postings += [(number[w], t, q) for q, w in enumerate(text) if number[w] in rare]
        word, template, place = np.array(sorted(postings)).T
        weight = np.array([math.log((1 + total) / (1 + frequencies[w])) + 1e-9 for w in order])
        return cls(order, weight, word, template, place)

    def phrase(self, own: np.ndarray, doc: np.ndarray, phrase: list[str]) -> np.ndarray:
        """Starts of a phrase, from the places of its rarest word."""
        ids = [self.order.index(w) for w in phrase]
        anchor = int(np.argmin(ids))
        start = np.flatnonzero(own == ids[anchor]) - anchor
        start = start[(start >= 0) & (start + len(ids) <= len(own))]
        for k, i in enumerate(ids):
            start = start[own[start + k] == i]
        return start[doc[start] == doc[start + len(ids) - 1]]

    def places(self, own: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, start among all words, text) on which enough rare licence words of the text agree."""
        at = np.flatnonzero(own >= 0)
        at = at[np.isin(own[at], np.unique(self.posting_word))]
        low, high = (np.searchsorted(self.posting_word, own[at], side) for side in ("left", "right"))
        n = high - low
        posting = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        votes = np.stack([self.posting_template[posting], np.repeat(at, n) - self.posting_place[posting], np.repeat(doc[at], n)], 1)
        places, agree = np.unique(votes, axis=0, return_counts=True) if len(votes) else (votes, np.zeros(0, int))
        needed = np.minimum(AGREE, np.bincount(self.posting_template, minlength=len(_TEXTS)))
        good = agree >= needed[places[:, 0]]
        return places[good, 0], places[good, 1], places[good, 2]


def scanned(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def run(batches):
        for piece in pieces(batches):
            own, offsets = _licence_words(piece.column("text"), index.order)
            m = piece.num_rows
            doc = np.repeat(np.arange(m), np.diff(offsets))
            n_base, score = np.zeros(m, np.int64), np.zeros(m)
            first, last = np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
            base: list[set] = [set() for _ in range(m)]
            more: list[set] = [set() for _ in range(m)]
            for phrase, label in BASE.items():
                start = index.phrase(own, doc, _PHRASES[phrase])
                of, place = doc[start], start - offsets[doc[start]]
                n_base += np.bincount(of, minlength=m)
                np.minimum.at(first, of, place)
                np.maximum.at(last, of, place)
                score[of] = 1.0
                for d in set(of.tolist()):
                    base[d].add(label)
            starts_of: dict[tuple[str, ...], np.ndarray] = {}
            labels = list(_TEXTS)
            for t, start, d in zip(*(x.tolist() for x in index.places(own, doc))):
                text, phrases = _TEXTS[labels[t]]
                low, high = max(start, offsets[d]), min(start + len(text), offsets[d + 1])
                verified = True
                for p in phrases:
                    if tuple(p) not in starts_of:
                        starts_of[tuple(p)] = index.phrase(own, doc, p)
                    found = starts_of[tuple(p)]
                    k = int(np.searchsorted(found, low))
                    verified = verified and k < len(found) and found[k] + len(p) <= high
                if verified:
                    ids = np.array([index.order.index(w) for w in text])
                    same = own[low:high] == ids[low - start:high - start]
                    score[d] = max(score[d], float(index.weight[ids[low - start:high - start]][same].sum() / index.weight[ids].sum()))
                    more[d].add(labels[t])
            joined = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            none = n_base == 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "n_words": pa.array(np.diff(offsets).astype(np.int64)), "n_base": pa.array(n_base),
                "first_word": pa.array(first, pa.int64(), mask=none), "last_word": pa.array(last, pa.int64(), mask=none),
                "base_labels": joined(base), "labels": joined(a | b for a, b in zip(base, more)), "score": pa.array(score)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(docs: DataFrame) -> DataFrame:
    return scanned(docs, Index.of(*document_frequencies(docs)))
