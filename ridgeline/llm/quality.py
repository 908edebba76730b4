"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features - hashed words and hashed character n-grams -
followed by a softmax layer.  Vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled documents.  For scoring, each bucket's vector is multiplied into the layer
once; a document's logits are then the average of its buckets' logits, which is the same model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import within_bytes

#: Character n-gram lengths, buckets (a power of two), vector size.
NGRAMS, BUCKET_BITS, DIMENSIONS = (3, 4, 5), 18, 16
#: The bounds of the training sample: documents, and bytes of their texts.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 4_000, 64_000_000
#: Passes over the sample, learning rate (falls linearly to zero), seed.
EPOCHS, RATE, SEED = 6, 0.5, 11
#: Scores from this value on predict label 1.
THRESHOLD = 0.7

_SHIFT = np.uint64(64 - BUCKET_BITS)
_WORD_SALT = np.uint64(0x5851F42D4C957F2D)
_TWICE_SALT = np.uint64(0x2545F4914F6CDD1D)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) arrays, ascending by document: words, words that repeat the one before, and n-grams.

    Words are runs of other than ASCII white space.  An n-gram is n consecutive characters within a word
    that is framed by one character on either side; case is kept.
    """
    words = K.Words(data, offsets, K.NOT_SPACE, K.EXACT)
    of = words.documents()
    out = [(of, _bucket(K.mix(words.hashes ^ _WORD_SALT)))]
    again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])) + 1
    out.append((of[again], np.full(len(again), int(_bucket(K.mix(np.array([_TWICE_SALT])))[0]))))
    heads = np.flatnonzero(K.starts_of_characters(data))
    at = np.append(heads, len(data))
    bounds = np.searchsorted(heads, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    spaces = np.zeros(len(heads) + 1, dtype=np.int64)
    np.cumsum(K.SPACE[data[heads]], out=spaces[1:])
    sums = K.prefix_sums(data, K.EXACT)
    _, down = K.powers(len(data) + 1)
    for n in NGRAMS:
        m = len(heads) - n + 1
        if m <= 0:
            continue
        first = np.flatnonzero((spaces[n - 1 : n - 1 + m] == spaces[1 : 1 + m]) & (owner[n - 1 :] == owner[:m]))
        a, b = at[first], at[first + n]
        out.append((owner[first], _bucket(K.mix((sums[b] - sums[a]) * down[a] + np.uint64(n)))))
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SHIFT).astype(np.int64)


@dataclass
class Model:
    """Logit difference of each bucket and the layer's bias; ``score`` is the probability of label 1."""

    buckets: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each document of a block."""
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for of, bucket in features(data, offsets):
            bounds = np.searchsorted(of, np.arange(n + 1))
            total += K.sums_by_document(self.buckets[bucket].astype(np.float64), bounds)
            count += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


def train(documents: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Train vectors and softmax layer on (text, label) pairs; with one class or none, the prior alone."""
    labels = np.array([label for _, label in documents], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        prior = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), float(np.log(prior / (1 - prior))))
    bags = []
    for text, _ in documents:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        found = np.concatenate([b for _, b in features(raw, np.array([0, len(raw)]))])
        bucket, times = np.unique(found, return_counts=True)
        bags.append((bucket.astype(np.int32), (times / max(1, len(found))).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BUCKET_BITS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)).tolist():
            bucket, weight = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            hidden = weight @ vectors[bucket]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            pull = layer @ error
            layer -= now * np.outer(hidden, error)
            bias -= now * error
            # each feature's step is scaled by the document's mean count, as if each occurrence were a step of its own
            vectors[bucket] -= (now * len(bucket)) * weight[:, None] * pull
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(documents: DataFrame, labels: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_DOCUMENTS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``most`` labelled documents: those of smallest id hash among the eligible labelled ids.

    The ids are chosen from the label table alone and broadcast (``most`` ids), so documents are not
    shuffled.  An id with contradicting labels, or with a null one, is left out, and so are texts that
    ``most_bytes`` no longer hold (taken by hash of the text).
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null")
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top"), F.count(F.lit(1)).alias("n"), F.count("label").alias("known")).where("label = top and n = known and label in (0, 1)")
    chosen = chosen.where(eligible).orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(most).select("id", "label")
    ids = {r.id: r.label for r in chosen.collect()}
    small = documents.sparkSession.createDataFrame([(k, v) for k, v in sorted(ids.items())], chosen.schema)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(small), "id").where("text is not null")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))  # an id's repeated rows count once
    return [(r.text, r.label) for r in sorted(within_bytes(rows, "text", most_bytes), key=lambda r: r.id)]


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """``id_col, *keep, score_col`` of every whole text; null and empty texts get the score of the bias alone."""
    dtypes = dict(documents.dtypes)
    passed = [id_col, *keep]
    rows = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(passed)], F.col(text_col).alias("text"))
    schema = pa.schema([(f"c{i}", K.arrow_type(documents, c)) for i, c in enumerate(passed)] + [("score", pa.float64())])
    held = documents.sparkSession.sparkContext.broadcast(model)
    made = rows.mapInArrow(K.map_texts([f"c{i}" for i in range(len(passed))], "text", lambda data, offsets, _: (held.value.scores(data, offsets),), schema), ", ".join([f"c{i} {dtypes[c]}" for i, c in enumerate(passed)] + ["score double"]))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(passed)], F.col("score").alias(score_col))
