"""The quality classifier against plain Python: features occurrence by occurrence, and every step of the descent."""

import math
import re

import numpy as np

from ridgeline.llm import quality

TEXTS = [("good clear words here and here", 1), ("spam spam spam!! Ünï", 0), ("", 1), ("x", 0), ("plain calm prose, again clear", 1), ("buy buy now!!\tnow", 0), (" lead and trail ", 1)]


def occurrences(text):
    """Feature names in the order of ``quality.features``."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = [[("word", w) for w in words], [("twice",) for a, b in zip(words, words[1:]) if a == b]]
    for n in quality.NGRAMS:
        grams = (text[i : i + n] for i in range(len(text) - n + 1))
        out.append([("gram", g) for g in grams if not re.search(r"[\x20\x09-\x0D]", g[1:-1])])
    return [x for part in out for x in part]


def buckets(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.concatenate([b for _, b in quality.features(raw, np.array([0, len(raw)]))]).tolist()


def test_features_are_those_of_each_occurrence():
    of = {}
    for text, _ in TEXTS:
        names, found = occurrences(text), buckets(text)
        assert len(names) == len(found)
        for name, bucket in zip(names, found):
            assert of.setdefault(name, bucket) == bucket
    assert len(set(of.values())) >= 0.98 * len(of)


def test_training_takes_the_steps_of_plain_descent():
    epochs, rate, seed = 3, quality.RATE, 11
    rng = np.random.default_rng(seed)
    start = (rng.random((1 << quality.BUCKET_BITS, quality.DIMENSIONS)) - 0.5) / quality.DIMENSIONS
    bags = [buckets(text) for text, _ in TEXTS]
    vectors = {b: start[b].astype(np.float32).tolist() for bag in bags for b in bag}
    d = quality.DIMENSIONS
    layer, bias = [[0.0, 0.0] for _ in range(d)], [0.0, 0.0]
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(TEXTS)).tolist():
            bag, label = bags[i], TEXTS[i][1]
            now = rate * (1 - step / (epochs * len(TEXTS)))
            step += 1
            hidden = [sum(vectors[b][k] for b in bag) / max(1, len(bag)) for k in range(d)]
            logits = [sum(hidden[k] * layer[k][c] for k in range(d)) + bias[c] for c in (0, 1)]
            p = [math.exp(x - max(logits)) for x in logits]
            error = [x / sum(p) - (c == label) for c, x in enumerate(p)]
            pull = [sum(layer[k][c] * error[c] for c in (0, 1)) for k in range(d)]
            for k in range(d):
                for c in (0, 1):
                    layer[k][c] -= now * hidden[k] * error[c]
            bias = [bias[c] - now * error[c] for c in (0, 1)]
            scale = len(set(bag)) / max(1, len(bag))
            for b in bag:  # one step for each occurrence
                vectors[b] = [vectors[b][k] - now * scale * pull[k] for k in range(d)]
    model = quality.train(TEXTS, epochs=epochs, rate=rate, seed=seed)
    assert abs(model.bias - (bias[1] - bias[0])) < 1e-3
    for text, _ in [*TEXTS, ("clear spam words " * 3, 0)]:
        bag = [b for b in buckets(text) if b in vectors]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        if len(bag) < len(buckets(text)):
            continue
        logit = sum(vectors[b][k] * (layer[k][1] - layer[k][0]) for b in bag for k in range(d)) / max(1, len(bag)) + bias[1] - bias[0]
        assert abs(model.scores(raw, np.array([0, len(raw)]))[0] - 1 / (1 + math.exp(-logit))) < 1e-3
