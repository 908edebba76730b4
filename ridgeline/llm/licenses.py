"""License scans: phrases in place, and an exact set-similarity join of text blocks with license templates.

The blocks of a text are its windows of ``STRETCH`` times as many consecutive words as the template has, across
line breaks.  A template matches a block that holds at least ``THRESHOLD`` of the template's distinct words.
Template words are ordered by how often the whole corpus holds them, rarest first; then a block can only match
if it holds one of the template's first ``size - needed + 1`` words (prefix filter), so only blocks around such a
word are looked at, and of these only where enough template words lie near (length filter) of which enough
come later in the order than that word (positional filter).  What passes is verified exactly.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences by which works state a license, with a label of the template's own.
TEMPLATES = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "apache-notice": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
#: The share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Words in a block for each word of the template.
STRETCH = 1.5


def _words(text: str) -> list[str]:
    found = K.words_of(text, K.ALNUM_OR_WIDE, K.FOLDED)
    return [found.data[a:b].tobytes().decode().lower() for a, b in zip(found.starts, found.ends)]


def _hash(word: str) -> int:
    return int(K.words_of(word, K.ALNUM_OR_WIDE, K.FOLDED).hashes[0])


class Vocabulary:
    """The distinct words of all templates (bounded by the templates), by hash."""

    def __init__(self, templates: dict[str, str]):
        words = sorted({w for t in templates.values() for w in _words(t)})
        pairs = sorted((_hash(w), w) for w in words)
        self.hashes = np.array([h for h, _ in pairs], dtype=np.uint64)
        self.words = [w for _, w in pairs]
        self.templates = {label: sorted({self.words.index(w) for w in _words(t)}) for label, t in templates.items()}
        self.sizes = {label: len(_words(t)) for label, t in templates.items()}
        self.lengths = np.array([len(w.encode()) for w in self.words], dtype=np.int64)
        self.letters = np.zeros((len(words), max(self.lengths, default=0)), dtype=np.uint8)
        for i, w in enumerate(self.words):
            self.letters[i, : self.lengths[i]] = list(w.encode())
        self.slots = np.zeros(1 << 16, dtype=bool)
        self.slots[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, vocabulary number) of the words in the vocabulary: looked up by hash, then compared byte by byte."""
        maybe = np.flatnonzero(self.slots[(words.hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, words.hashes[maybe]), len(self.hashes) - 1)
        starts, lengths = words.starts[maybe], words.ends[maybe] - words.starts[maybe]
        same = np.flatnonzero((self.hashes[at] == words.hashes[maybe]) & (lengths == self.lengths[at]))
        column = np.arange(self.letters.shape[1])
        held = words.data[np.minimum(starts[same, None] + column, len(words.data) - 1)] if len(same) else np.zeros((0, len(column)), np.uint8)
        held = np.where((held >= 65) & (held <= 90), held + 32, held)
        equal = ((held == self.letters[at[same]]) | (column >= lengths[same, None])).all(axis=1)
        return maybe[same[equal]], at[same[equal]]


def word_frequencies(documents: DataFrame, text_col: str, vocabulary: Vocabulary) -> np.ndarray:
    """How often all documents together hold each vocabulary word."""
    schema = pa.schema([("number", pa.int64()), ("times", pa.int64())])
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        total = np.zeros(len(held.value.words), dtype=np.int64)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for _, _, block, own in K.blocks(data, offsets):
                _, number = held.value.find(K.Words(block, own, K.ALNUM_OR_WIDE, K.FOLDED))
                total += np.bincount(number, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total, pa.int64())], schema=schema)

    rows = documents.select(F.col(text_col).alias("text")).mapInArrow(count, "number bigint, times bigint").groupBy("number").agg(F.sum("times").alias("times"))
    out = np.zeros(len(vocabulary.words), dtype=np.int64)
    for r in rows.collect():  # a row for each vocabulary word
        out[r.number] = r.times
    return out


class PrefixIndex:
    """The templates' words under the global order, with what a match needs."""

    def __init__(self, vocabulary: Vocabulary, frequencies: np.ndarray, threshold: float = THRESHOLD, stretch: float = STRETCH):
        rank = np.empty(len(frequencies), dtype=np.int64)
        rank[np.lexsort((np.arange(len(frequencies)), frequencies))] = np.arange(len(frequencies))
        self.templates = []
        for label, numbers in vocabulary.templates.items():
            place = np.full(len(rank), -1, dtype=np.int64)  # of each word in the template's order
            place[sorted(numbers, key=lambda n: rank[n])] = np.arange(len(numbers))
            need = math.ceil(threshold * len(numbers) - 1e-9)
            self.templates.append((label, place, len(numbers), need, math.ceil(stretch * vocabulary.sizes[label] - 1e-9)))

    def matches(self, at: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str, float]]:
        """(word, label, containment) of the blocks that match a template: the best (ties: the first), then the best that overlaps none taken, and so on.

        ``at``, ``number``: the vocabulary words of some documents, ascending by place; ``bounds``: the documents' first words.
        """
        out = []
        for label, place, size, need, width in self.templates:
            own = place[number]
            held = np.flatnonzero(own >= 0)
            own, words = own[held], at[held]
            rare = np.flatnonzero(own < size - need + 1)
            of = np.searchsorted(bounds, words[rare], "right") - 1
            low = np.searchsorted(words, np.maximum(words[rare] - width + 1, bounds[of]))
            high = np.searchsorted(words, np.minimum(words[rare] + width, bounds[of + 1]))
            blocks: list[tuple[float, int, int]] = []  # (containment below zero, first word, document)
            tried: set[int] = set()
            for q, d, a, b in zip(rare.tolist(), of.tolist(), low.tolist(), high.tolist()):
                if b - a < need or len(set(own[a:b][own[a:b] >= own[q]].tolist())) < need:  # blocks with a rarer word are met at that word
                    continue
                for s in range(a, q + 1):
                    if s not in tried:
                        tried.add(s)
                        common = len(set(own[s : s + int(np.searchsorted(words[s:b], words[s] + width))].tolist()))
                        if common >= need:
                            blocks.append((-common / size, int(words[s]), d))
            taken: dict[int, list[int]] = {}  # by document the first words of the blocks taken, ascending
            for below, word, d in sorted(blocks):
                own = taken.setdefault(d, [])
                k = bisect.bisect(own, word)
                if (k == 0 or own[k - 1] + width <= word) and (k == len(own) or word + width <= own[k]):
                    own.insert(k, word)
                    out.append((word, label, -below))
        return out


def license_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Phrase places and template matches of each whole text.

    Returns ``id_col, n_words, n_base, first_word, last_word, base_labels, template_labels, matches, score``:
    all places of phrases, the smallest and largest start (in words from 0, null without a place), distinct
    sorted labels, the matching blocks of each template, best first, none overlapping a better one of its template,
    ``array<struct<label,word,containment>>`` (``word``: its first word of the template, in words from 0) and the best containment (1 for a phrase; 0 without any match).
    Null and empty texts have no words; repeated rows each get theirs.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    vocabulary = Vocabulary({**templates, **{f"phrase {p}": p for p in phrases}})
    vocabulary.templates = {k: v for k, v in vocabulary.templates.items() if k in templates}
    index = PrefixIndex(vocabulary, word_frequencies(documents, text_col, vocabulary), threshold)
    sequences = [([vocabulary.words.index(w) for w in _words(p)], label) for p, label in phrases.items()]
    kind = dict(documents.dtypes)[id_col]
    match = pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())])
    schema = pa.schema([("id", K.arrow_type(documents, id_col)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("template_labels", pa.list_(pa.string())), ("matches", pa.list_(match)), ("score", pa.float64())])
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, index, sequences))

    def work(data, offsets, batch):
        vocabulary, index, sequences = shared.value
        words = K.Words(data, offsets, K.ALNUM_OR_WIDE, K.FOLDED)
        n = len(offsets) - 1
        at, number = vocabulary.find(words)
        of = words.documents()
        codes = np.full(len(words.hashes), -1, dtype=np.int64)
        codes[at] = number
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        for sequence, label in sequences:
            first = at[number == sequence[0]]
            for k, code in enumerate(sequence[1:], 1):
                first = first[first + k < len(codes)]
                first = first[(codes[first + k] == code) & (of[first + k] == of[first])]
            for i in first.tolist():
                places[of[i]].append(i - int(words.bounds[of[i]]))
                base[of[i]].add(label)
        matches: list[list[dict]] = [[] for _ in range(n)]
        for word, label, containment in index.matches(at, number, words.bounds):
            d = int(np.searchsorted(words.bounds, word, "right")) - 1
            matches[d].append({"label": label, "word": word - int(words.bounds[d]), "containment": containment})
        score = [max([1.0] * bool(places[d]) + [m["containment"] for m in matches[d]], default=0.0) for d in range(n)]
        return words.counts, [len(x) for x in places], [min(x, default=None) for x in places], [max(x, default=None) for x in places], [sorted(x) for x in base], [sorted({m["label"] for m in x}) for x in matches], matches, score

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, template_labels array<string>, matches array<struct<label:string,word:bigint,containment:double>>, score double"
    return rows.mapInArrow(K.map_texts(["id"], "text", work, schema), ddl).withColumnRenamed("id", id_col)
