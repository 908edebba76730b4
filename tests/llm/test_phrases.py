"""Collocations, spelling variants and repeated passages against plain versions, with odd rows and planted cases."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from ridgeline.llm import collocations, countmin, spelling, substrings  # noqa: E402
from ridgeline.llm import kernels as K  # noqa: E402

ODD = [None, "", " \t\n ", "one", "x" * 3000, "ünï çödé × ÷ ÿ", "a\x00b\x0bc\x0cd\re f"]


def frame(spark, rows, schema="doc_id long, text string, lang string, phrase int, n string, word string, id string, ranges int"):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], schema).repartition(5)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(21)
    words = ["The", "new", "york", "stock", "exchange", "de", "la", "über", "a", "b", "c-d", "(x)"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "!", "\n", "\t", "  "]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [*ODD, "New York, Stock exchange. " * 40, "tie one tie two tie one tie two " * 30, ("v w " * 5000).strip()]
    return [(i, t, rng.choice(["en", "fr", None, "und"])) for i, t in enumerate(texts)] + [(1, texts[1], "en")] * 3


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (3, 2, 7), (4, 3, 50), (2, 1, 2000)])
def test_collocations(spark, phrases, longest, least, top):
    found = collocations.collocations(frame(spark, phrases), longest=longest, least=least, top=top, bits=16)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(plain.collocation_rows([(r[2], r[1]) for r in phrases], longest, least, top=top))


def test_collocations_without_rows(spark):
    for rows in ([], [(1, None, "en"), (2, "", None)]):
        assert collocations.collocations(frame(spark, rows) if rows else spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9 * 10**14, 10**15 - 1, 9 * 10**14 + 7)], "a long, l1 long, r1 long")
    a, left, right = rows.first()
    assert rows.select(collocations._score("l1", "r1").alias("s")).first().s == 1000000 * a * a // (left * right)


def test_a_sketch_never_counts_too_little(spark):
    rng = np.random.default_rng(3)
    items = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    often = rng.integers(1, 9, len(items))
    stream = rng.permutation(np.repeat(items, often))
    batches = [countmin.sketch_rows(part, None, 2, 16, 5) for part in np.array_split(stream, 13)]
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    filled = countmin.merged(spark.createDataFrame(rows, countmin.SCHEMA).repartition(3), 2, 16, 5)
    said = filled.often(items)
    assert said[often >= 5].all()
    assert said[often < 5].mean() < 0.2
    assert (countmin.merged(spark.createDataFrame([], countmin.SCHEMA), 2, 16, 5).often(items) == False).all()  # noqa: E712
    with pytest.raises(ValueError):
        countmin.merged(spark.createDataFrame([], countmin.SCHEMA), 2, 16, 1 << 16)


def variants(rng, base, n):
    out = []
    for _ in range(n):
        w, k = rng.choice(base), None
        k = rng.randrange(len(w))
        out.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :], w + "a"]))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefghiké", "aaab"])
def test_near_words_are_all_found(spark, letters):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(150)]
    words = {w: rng.randint(5, 400) for w in base + variants(rng, base, 250) + ["a" * k for k in range(6, 12)] if len(w) >= 6}
    found = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    want = {(a, words[a], b, words[b]) for a in words for b in words if plain.one_edit_apart(a, b)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_spelling_variants(spark):
    rng = random.Random(31)
    base = ["".join(rng.choice("etaonïÉs") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    weights = [3 ** rng.randint(0, 6) for _ in base]
    pool, own = base + variants(rng, base, 60), weights + [1] * 60
    rows = [(i if i % 9 else None, " ".join(rng.choices(pool, own, k=300)) + rng.choice([" ", "-", "1"]) + rng.choice(base).upper()) for i in range(50)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [rows[3]] * 4
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(frame(spark, rows)).collect()}
    want = plain.spelling_rows(plain.spelling_words(rows))
    assert found == want
    assert sum(f is not None for _, _, f, _, _ in want.values()) > 10
    dense = spelling.group_variants(frame(spark, rows), deleted_one_in=3, least_count=2)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in dense.collect()} == plain.spelling_rows(plain.spelling_words(rows, least=2, one_in=3))


def test_long_chains_of_forms(spark):
    chain = ["abcdefgh"[:k] + "z" * (8 - k) for k in range(9)]
    rows = [(i, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))) for i in range(2)]
    found = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), ratio=2, deleted_one_in=1 << 40).collect()}
    assert all(found[w].root == chain[-1] for w in chain)
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), ratio=1)


def test_spelling_without_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None), (None, ""), (2, "ab 12")], "doc_id long, text string")).count() == 0


def passages(rng):
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    shared = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))))
            parts.append(rng.choice([" ", "\n", " \t "]))
        texts.append("".join(parts))
    return texts + [texts[3], texts[3], " ".join(texts[:20])] + ODD + ["a " * 500, "a " * 40, "a b " * 100]


@pytest.mark.parametrize(("window", "gram"), [(5, 2), (12, 4), (3, 3), (50, 8)])
def test_repeated_passages(spark, window, gram):
    rng = random.Random(window)
    texts = passages(rng)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(ids[0], texts[5]), (ids[0], texts[5]), (None, texts[3]), (None, None)]
    found = substrings.drop_repeats(frame(spark, rows), window=window, gram=gram, bits=16)
    want = plain.kept_words(rows, window)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=key)
    assert any(0 < gone < n for n, gone, _ in want)


def test_repeated_passages_with_string_ids_and_long_texts(spark):
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefghijk") for _ in range(4)) for _ in range(60_000))
    cut = " ".join(long.split()[20_000:20_100])
    rows = [("b", long), ("a", "früh " + cut + " spät"), ("c", cut[5:] + " Ende"), ("d", None)]
    found = {r.doc_id: r for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = dict(zip([r[0] for r in rows], plain.kept_words(rows)))
    assert {i: (r.n_words, r.n_removed, r.text) for i, r in found.items()} == want
    assert want["b"][1] == 100 and want["a"][1] == 0 and want["c"][2] == "Ende"
    empty = substrings.drop_repeats(spark.createDataFrame([], "doc_id string, text string"))
    assert empty.count() == 0


def test_anchors_stand_for_every_window():
    rng = random.Random(4)
    data, offsets = np.frombuffer(" ".join(rng.choice(["a", "b", "cc"]) for _ in range(400)).encode(), np.uint8), None
    offsets = np.array([0, 300, 310, len(data)])
    words = K.Words(data, offsets, K.NOT_SPACE, K.EXACT)
    found = substrings.Anchors(words, 7, 3)
    starts = [i for i in range(len(words.starts)) if i + 7 <= words.bounds[np.searchsorted(words.bounds, i, "right")]]
    assert [i for a, b in zip(found.first, found.end) for i in range(a, b)] == starts
    hashes, bounds = found.windows(np.arange(len(found.first)))
    spelt = [tuple(data[words.starts[k] : words.ends[k]].tobytes() for k in range(i, i + 7)) for i in starts]
    anchor = np.repeat(found.hashes, found.end - found.first)
    assert len(set(zip(hashes.tolist(), anchor.tolist()))) == len(set(hashes.tolist())) == len(set(spelt))
