"""Language ID: unigram piece models per language over a fixed public vocabulary, marginalised over segmentations.

A word's probability in a language is the sum, over every way to cut it into vocabulary pieces, of the product
of the pieces' probabilities; the forward algorithm computes it without listing the ways.  A text's
log-probability is the sum over its words.  The pieces' probabilities are learnt per language by
expectation maximisation (forward-backward) on the word counts of a bounded sample of labelled documents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch

#: A sentencepiece model file whose pieces are the vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of the training sample: expected documents of each language and of all together, and bytes of their texts.
SAMPLE_DOCUMENTS, SAMPLE_TOTAL, SAMPLE_BYTES = 1_500, 12_000, 64_000_000
#: Rounds of expectation maximisation, and the count that every piece gets beforehand.
ROUNDS, SMOOTHING = 3, 0.05
#: Longer words (unspaced scripts, encoded data) are learnt from in stretches of at most this many bytes.
LEARNT_BYTES = 512
#: Prediction for texts without a letter.
UNDETERMINED = "und"

#: Bytes of text whose distinct words are scored together, and of a task's table of words that it has scored.
WORDS_BYTES, CACHE_BYTES = 1 << 20, 1 << 24

_TABLE_BITS, _PROBES = 19, 8
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """The vocabulary as byte strings, a leading space marking a word's start, with a hash table for look-up.

    All single bytes belong to it, so that every text has a segmentation.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})
        self.lengths = sorted({len(p) for p in self.pieces})
        size = 1 << _TABLE_BITS
        self.slot_hash, self.slot_piece = np.zeros(size + _PROBES, dtype=np.uint64), np.full(size + _PROBES, -1, dtype=np.int32)
        self.probes = 1
        for i, piece in enumerate(self.pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for b in piece:
                    h = h * _STEP + K.EXACT[b]
            h = K.mix(np.array([h], dtype=np.uint64))[0]
            at = int(h >> np.uint64(64 - _TABLE_BITS))
            used = next(k for k in range(_PROBES) if self.slot_piece[at + k] < 0)
            self.slot_hash[at + used], self.slot_piece[at + used] = h, i
            self.probes = max(self.probes, used + 1)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Pieces:
        import sentencepiece

        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary at {path}: give the path of a sentencepiece model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        return cls([model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not special(i)])

    def find(self, sums: np.ndarray) -> np.ndarray:
        """Piece numbers of raw substring hashes; -1 where the substring is no piece."""
        h = K.mix(sums)
        at = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        found = np.where(self.slot_hash[at] == h, self.slot_piece[at], np.int32(-1))
        for k in range(1, self.probes):
            rest = np.flatnonzero(found < 0)
            found[rest] = np.where(self.slot_hash[at[rest] + k] == h[rest], self.slot_piece[at[rest] + k], np.int32(-1))
        return found


@dataclass
class Lattice:
    """Words of about one length as byte rows (a space first) and, by piece length, the pieces at each place."""

    members: np.ndarray
    lengths: np.ndarray
    places: dict[int, np.ndarray]


def lattices(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most_cells: int = 1 << 19) -> Iterator[Lattice]:
    """The words data[starts:ends], grouped by length so that a group's rows hold at most about ``most_cells`` bytes."""
    lengths = ends - starts + 1
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        limit = max(8, int(lengths[order[i]]) * 5 // 4)
        j = min(int(np.searchsorted(lengths[order], limit, "right")), i + max(1, most_cells // limit))
        members = order[i:j]
        width = int(lengths[members[-1]])
        column = np.arange(width - 1)
        inside = column[None, :] < (lengths[members] - 1)[:, None]
        rows = np.full((len(members), width), 32, dtype=np.uint8)
        rows[:, 1:] = np.where(inside, data[np.minimum(starts[members][:, None] + column[None, :], len(data) - 1)], 0) if width > 1 else 32
        values = K.EXACT[rows]
        sums, places = values, {1: pieces.find(values.ravel()).reshape(values.shape)}
        for k in range(2, min(pieces.lengths[-1], width) + 1):
            sums = sums[:, :-1] * _STEP + values[:, k - 1 :]
            if k in pieces.lengths:
                places[k] = pieces.find(sums.ravel()).reshape(sums.shape)
        yield Lattice(members, lengths[members], places)
        i = j


def forward(lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """Log-probability of each word of the lattice in each language; ``probability`` is pieces x languages.

    Each language's values are divided by its last position's, so that words of any length keep in range in
    every language; the divisors' logs are added up.
    """
    n, languages = len(lattice.members), probability.shape[1]
    width = int(lattice.lengths.max())
    longest = max(lattice.places)
    window = {0: np.ones((n, languages))}
    scale, out = np.zeros((n, languages)), np.zeros((n, languages))
    for j in range(1, width + 1):
        now = np.zeros((n, languages))
        for k, pieces in lattice.places.items():
            if k > j:
                continue
            piece = pieces[:, j - k]
            some = np.flatnonzero(piece >= 0)
            if len(some):
                now[some] += window[j - k][some] * probability[piece[some]]
        if j % 16 == 0:
            top = now.copy()
            for values in (now, *(window[i] for i in window)):
                values /= top
            scale += np.log(top)
        window[j] = now
        window.pop(j - longest, None)
        done = np.flatnonzero(lattice.lengths == j)
        if len(done):
            out[done] = np.log(now[done]) + scale[done]
    return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    top = np.max(terms, axis=0)
    base = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return base + np.log(np.exp(np.array(terms) - base).sum(axis=0))


def expected_counts(lattice: Lattice, weight: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the lattice's words, each word ``weight`` times; in logs, as words may be long."""
    n, width = len(lattice.members), int(lattice.lengths.max())
    logs = np.r_[np.log(probability), -np.inf]  # the last for no piece (-1)
    alpha, beta = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for j in range(1, width + 1):
        alpha[j] = _log_sum([alpha[j - k] + logs[pieces[:, j - k]] for k, pieces in lattice.places.items() if k <= j])
    beta[lattice.lengths, np.arange(n)] = 0
    for i in range(width - 1, -1, -1):
        after = _log_sum([beta[i + k] + logs[pieces[:, i]] for k, pieces in lattice.places.items() if k <= width - i])
        beta[i] = np.where(lattice.lengths == i, 0, after)
    total = alpha[lattice.lengths, np.arange(n)]
    out = np.zeros(len(probability))
    for k, pieces in lattice.places.items():
        for i in range(width - k + 1):
            piece = pieces[:, i]
            share = np.exp(alpha[i] + logs[piece] + beta[i + k] - total) * weight
            out += np.bincount(np.maximum(piece, 0), weights=share, minlength=len(out))
    return out


def _stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, end): words of over ``most`` bytes cut into stretches that begin with a character."""
    of, a, b = [np.arange(len(starts))], [starts], [ends.copy()]
    for w in np.flatnonzero(ends - starts > most).tolist():
        cuts = [int(starts[w])]
        while ends[w] - cuts[-1] > most:
            cut = cuts[-1] + most
            while cut > cuts[-1] + most - 4 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            cuts.append(cut)
        b[0][w] = cuts[1]
        of.append(np.full(len(cuts) - 1, w))
        a.append(np.array(cuts[1:]))
        b.append(np.array([*cuts[2:], ends[w]]))
    return np.concatenate(of), np.concatenate(a), np.concatenate(b)


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """A block's words, the first place of each distinct one, and each word's number among these."""
    words = K.Words(data, offsets, K.NOT_SPACE, K.EXACT)
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    return words, first, inverse


@dataclass
class Model:
    """Languages (sorted), the vocabulary and pieces x languages probabilities."""

    languages: list[str]
    pieces: Pieces
    probability: np.ndarray

    def log_likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """documents x languages for a block."""
        words, first, inverse = distinct_words(data, offsets)
        own = self._of_words(words, first)
        of, n = words.documents(), len(offsets) - 1
        return np.stack([np.bincount(of, weights=own[inverse, g], minlength=n) for g in range(len(self.languages))], axis=1) if self.languages else np.zeros((n, 0))

    def _of_words(self, words: K.Words, first: np.ndarray) -> np.ndarray:
        """words x languages; a table of fixed size holds the last word of each slot, so common words are scored once a task."""
        if not hasattr(self, "_words"):
            slots = 1 << max(4, int(np.log2(CACHE_BYTES / (8 + 8 * max(1, len(self.languages))))))
            self._words, self._scores = np.zeros(slots, dtype=np.uint64), np.zeros((slots, len(self.languages)))
        hashes = words.hashes[first]
        slot = (hashes & np.uint64(len(self._words) - 1)).astype(np.int64)
        out = self._scores[slot]
        new = np.flatnonzero(self._words[slot] != hashes)
        for lattice in lattices(self.pieces, words.data, words.starts[first[new]], words.ends[first[new]]):
            out[new[lattice.members]] = forward(lattice, self.probability)
        self._words[slot[new]], self._scores[slot[new]] = hashes[new], out[new]
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior probability under equal priors (ties: the first by name)."""
        n = len(offsets) - 1
        likelihoods = self.log_likelihoods(data, offsets)
        letters = _has_letter(data, offsets)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        best = likelihoods.argmax(axis=1)
        posterior = 1 / np.exp(likelihoods - likelihoods.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist())], np.where(letters, posterior, 0.0)


_LETTER = K.byte_class((0x41, 0x5A), (0x61, 0x7A))


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = K.sums_by_document(_LETTER[data].astype(np.int64), offsets) > 0
    for d in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return found


def train(samples: dict[str, list[str]], pieces: Pieces, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Learn each language's piece probabilities from sample texts."""
    languages = sorted(samples)
    probability = np.zeros((len(pieces.pieces), len(languages)))
    for g, language in enumerate(languages):
        raw = [t.encode("utf-8", "surrogatepass") for t in samples[language]]
        data, offsets = np.frombuffer(b" ".join(raw), dtype=np.uint8), None
        offsets = np.array([0, len(data)])
        words, first, inverse = distinct_words(data, offsets)
        word, starts, ends = _stretches(data, words.starts[first], words.ends[first], LEARNT_BYTES)
        weight = np.bincount(inverse, minlength=len(first)).astype(np.float64)[word]
        own = np.full(len(pieces.pieces), 1.0 / len(pieces.pieces))
        for _ in range(rounds):
            counts = np.full(len(own), smoothing)
            for lattice in lattices(pieces, data, starts, ends):
                counts += expected_counts(lattice, weight[lattice.members], own)
            own = counts / counts.sum()
        probability[:, g] = own
    return Model(languages, pieces, probability)


def training_texts(documents: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_DOCUMENTS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Distinct texts of each language from the eligible rows with a language: an expected ``most`` rows each, chosen by id hash.

    The languages share ``SAMPLE_TOTAL`` rows and ``most_bytes`` equally.  A language's texts are taken by hash of the
    text; the one that passes its share of the bytes is cut there, and every language keeps the start of one at least.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null").where(eligible)
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 24)))
    scratch = Scratch(documents.sparkSession, "languages")
    counts = scratch.write(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")), "counts")
    languages = counts.count()
    share = max(1, min(most, SAMPLE_TOTAL // max(languages, 1)))
    room = max(1, most_bytes // max(languages, 1))
    chosen = rows.join(counts, "lang").where((F.col("place") * F.col("n") < share * (1 << 24)) | (F.col("place") == F.col("least")))
    own = F.octet_length("text")
    held = scratch.write(chosen.select("lang", "text").distinct().withColumn("h", F.xxhash64("text")), "texts")
    before = F.sum(own).over(Window.partitionBy("lang").orderBy("h", "text")) - own
    kept = held.withColumn("left", room - before).where("left > 0").select("lang", F.expr("substring(text, 1, cast(left as int))").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(kept.collect()):
        out.setdefault(r.lang, []).append(r.text)
    scratch.close()
    return out


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of each whole text; ``und`` and 0 where it is null or has no letter."""
    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("id", K.arrow_type(documents, id_col)), ("lang_pred", pa.string()), ("score", pa.float64())])
    held = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(K.map_texts(["id"], "text", lambda data, offsets, _: held.value.predict(data, offsets), schema, WORDS_BYTES), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
