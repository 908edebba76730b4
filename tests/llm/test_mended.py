"""Cases that earlier versions missed: items without an id, shared budgets of bytes, groups of rules, many spans in a text,
tables that Spark sizes too low."""

import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from ridgeline.llm import decontamination, language, rules, secrets, spelling  # noqa: E402


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("part_bytes", [64_000_000, 900])
def test_items_without_an_id_hit_words(spark, part_bytes):
    rng = random.Random(1)
    items = [(None, sentence(rng, 14)), ("a", sentence(rng, 12)), ("b", "two words"), (None, None), (None, "lone")]
    texts = [items[0][1], "x " + items[1][1] + " y " + items[0][1], "here two words lone", sentence(rng, 40), None, ""]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontamination.contamination(documents, spark.createDataFrame(items, "item_id string, text string"), part_bytes=part_bytes).collect()
    for r in found:
        n, hit, named = plain.hits_row(texts[r.doc_id], [(i or "", t) for i, t in items])
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, [x for x in named if x])
    assert {r.doc_id: r.n_hit for r in found}[0] == 14


def test_languages_share_the_bytes_of_the_sample(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 200), "en") for i in range(30)] + [(50 + i, sentence(rng, 300), "fr") for i in range(2)]
    rows += [(90, "z" * 9000, "xx")] + [(100 + i, "one text", "de") for i in range(40)] + [(i + 200, sentence(rng, 3), f"dirty {i}") for i in range(60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = {r[2] for r in rows}
    for most in (1, 5_000, 200_000, 64_000_000):
        found = language.training_texts(documents, F.lit(True), most_bytes=most)
        assert set(found) == every
        room = max(1, most // len(every))
        assert all(sum(len(t.encode()) for t in texts) <= room for texts in found.values())
        assert found["de"] == ["one text"[:room]]
    assert sorted(found["en"]) == sorted(r[1] for r in rows[:30])
    assert language.training_texts(documents.where("false"), F.lit(True)) == {}


@pytest.mark.parametrize("groups", [("lang",), ("lang", "source", "kind")])
def test_rules_by_any_number_of_groups(spark, groups):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(5, 60)) + " #$" * rng.choice([0, 0, 30]), rng.choice(["en", None]), rng.choice("ab"), 1) for i in range(80)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind int")
    found = {r.doc_id: r for r in rules.quality_rules(documents, groups=groups).collect()}
    assert len(found) == 80
    alike = documents.withColumn("source", F.lit("one")) if groups == ("lang",) else documents
    want = {r.doc_id: r.kept for r in rules.quality_rules(alike).collect()}
    assert {i: r.kept for i, r in found.items()} == want


def test_many_spans_in_one_text():
    rng = random.Random(4)
    words = [rng.choice(["token=" + "".join(rng.choice("abcXYZ0189") for _ in range(12)), "deadbeef" * 4, "plain-word/x", "AKIA" + "Z9" * 10, "é"]) for _ in range(4000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    tokens = secrets._tokens(data, offsets)
    found, free = secrets._base(data, offsets, tokens)
    text = data.tobytes().decode()
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    taken = np.zeros(len(text), dtype=bool)
    for a, b, *_ in found[0]:
        taken[a:b] = True
    assert free.tolist() == [not taken[chars[a] : chars[b]].any() for a, b in zip(tokens[1], tokens[2])]
    assert len(found[0]) > 1500 and free.any()


def test_a_kind_with_one_credential_is_learnt():
    rng = random.Random(5)
    formats = secrets.Formats({"few": ["kx-4f9Q2z81LmPq07"]}, [sentence(rng, 2).replace(" ", "") for _ in range(50)])
    assert set(formats.kinds) == {"few"}


def test_spelling_broadcasts_bigram_counts_alone(spark):
    rng = random.Random(4)
    text = sentence(rng, 60) + " gardening gardeninq gardenin"
    documents = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    joins = lambda rows: re.findall(r"(\w+Join) \[(?:\w+\.)?(\w+)#", rows._jdf.queryExecution().executedPlan().toString())
    found = spelling.group_variants(documents)
    assert set(joins(spelling.near_pairs(spelling.word_counts(documents)))) == {("BroadcastHashJoin", "gram"), ("SortMergeJoin", "key")}
    assert set(joins(found)) == {("SortMergeJoin", "word")}
    assert {r.word: r.n_near for r in found.collect()}["gardening"] == 2
