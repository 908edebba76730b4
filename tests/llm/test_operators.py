"""The operators against plain versions, on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import itertools
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from ridgeline.llm import decontamination, language, licenses, linededup, neardup, packing, quality, rules, secrets, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string, bucket int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(5, 80)) for _ in range(30)]
    near = [b + " " + sentence(rng, 2) for b in base[:8]]
    key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    odd = [None, "", "   \n\t ", "one", base[0], base[0], base[0].upper(), sentence(rng, 30_000), f"héllo password = 'hunter2hunter2' {key}", "deadbeef" * 4, "\n".join([base[3], base[4], base[3], "x"]), "Released under the MIT License.\nGNU General Public License", "é" * 50 + " " + base[5], base[9] + " " + base[10]]
    return dict(enumerate(base + near + odd))


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "web", None, i % 3, "x", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_secrets(documents, texts):
    found = secrets.secret_scan(documents, secrets.learn(documents)).collect()
    assert len(found) == len(texts)
    for row in found:
        spans = [s for s in row.spans if s.kind != secrets.LEARNT]
        n = plain.secret_row(texts[row.doc_id])
        assert [sum(s.kind == k for s in spans) for k in ("assign", "access", "hex")] == list(n[:3])
        assert hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans).encode()).hexdigest() == n[3]


ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def test_an_automaton_prefers_its_format():
    rng = random.Random(1)
    token = lambda n=36: "ghp_" + "".join(rng.choice(ALNUM) for _ in range(n))
    formats = secrets.Formats({"gh": [token() for _ in range(200)]}, [sentence(rng, 3).replace(" ", "") for _ in range(200)])
    ratio = lambda t: formats.score(t) / len(t)
    assert ratio(token()) > secrets.LEAST_RATIO
    assert all(ratio(t) < secrets.LEAST_RATIO for t in ("abcdefghijklmnopabcdefg", "1.2.3.4.5.6.7.8.9.10", "2024-11-28", "202411281530", "usr/local/bin/python"))
    raw = [token() for _ in range(40)] + ["x", "aB3" * 300]
    data = np.frombuffer("".join(raw).encode(), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in raw])
    assert np.allclose(formats.scores(data, ends - [len(t) for t in raw], ends), [formats.score(t) for t in raw])
    cost, to, end, at = formats.kinds["gh"].table()
    total = 0.0
    for c in secrets.symbols(raw[0]):
        total, at = total + cost[at, secrets.SYMBOLS.index(c)], to[at, secrets.SYMBOLS.index(c)]
    assert np.isclose(total + end[at], formats.kinds["gh"].log_likelihood(secrets.symbols(raw[0])))


def test_learnt_secrets_in_texts(spark):
    rng = random.Random(2)
    token = lambda: "gl-" + "".join(rng.choice(ALNUM) for _ in range(30))
    held = [token() for _ in range(4)]
    rows = [(i, f"ügly {sentence(rng, 20)} (see {t}). url=/x/{t}/y {sentence(rng, 5)}") for i, t in enumerate(held)] + [(9, sentence(rng, 400)), (10, None), (11, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secrets.learn(documents, labelled={"gl": [token() for _ in range(60)]})
    found = {r.doc_id: [s for s in r.spans if s.kind == secrets.LEARNT] for r in secrets.secret_scan(documents, formats).collect()}
    for i, t in enumerate(held):
        text = rows[i][1]
        assert [text[s.start : s.end] for s in found[i]] == [t, t]
    assert not found[9] and not found[10] and not found[11]


def test_near_duplicates(documents, texts):
    found = {r.doc_id: r for r in neardup.near_duplicates(documents, shingle=4).collect()}
    want = plain.near_duplicate_components(texts, 4)
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(found[i].n_shingles == len(plain.shingles(t, 4)) and found[i].kept == (want[i] == i) for i, t in texts.items())


def test_near_duplicates_of_large_groups(spark):
    rng = random.Random(3)
    base = sentence(rng, 120)
    texts = {i: base if i < 200 else base.replace(base.split()[i % 100], "zz", 1) for i in range(400)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(rows, shingle=4).collect()} == plain.near_duplicate_components(texts, 4)


def test_near_duplicates_beside_a_large_group(spark):
    rng = random.Random(8)
    words = sentence(rng, 133).split()
    texts = {i: " ".join(words[:k] + ["zz"] + words[k + 1 :]) for i, k in enumerate(range(0, 132, 2))}  # one large group
    for i in range(60):  # pairs of excerpts, 0.82 to each other, 0.77 and less to the group
        own = list(words)
        for k in rng.sample(range(133), 4):
            own[k] = f"w{i}x{k}"
        first = rng.randrange(0, 20)
        texts[1000 + 2 * i], texts[1001 + 2 * i] = " ".join(own[first : first + 103]), " ".join(own[first + 10 : first + 113])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    want = plain.near_duplicate_components(texts, 4)
    for worthwhile in (0.0, 1.0):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(rows, shingle=4, worthwhile=worthwhile).collect()} == want


def test_near_duplicate_links_over_a_similar_background(spark):
    rng = random.Random(12)
    words = sentence(rng, 3000).split()
    texts = {}
    for i in range(40):  # pairs just above 0.8 to each other, all pairs about 0.77
        own = list(words)
        for k in rng.sample(range(3000), 98):
            own[k] = f"a{i}x{k}"
        texts[2 * i] = " ".join(own)
        for k in rng.sample(range(3000), 77):
            own[k] = f"b{i}x{k}"
        texts[2 * i + 1] = " ".join(own)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    want = plain.near_duplicate_components(texts, 4)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(rows, shingle=4).collect()} == want


def test_near_duplicates_link_all_texts_of_an_id(spark):
    rng = random.Random(13)
    a, b = sentence(rng, 30), sentence(rng, 30)
    rows = [(3, a), (5, a), (5, b), (7, b), (None, a), (8, None), (9, "")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in found if r.doc_id) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True), (9, 9, True)]
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def test_rules(spark, documents):
    rng = random.Random(14)
    line = lambda n: sentence(rng, n)
    words = line(57).split()
    rows = [(i, "\n".join(line(12) for _ in range(rng.randint(2, 6))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(1000, " ".join(["###$$$"] * 8 + words), "en", "a"), (1001, "\n".join(w if i % 2 else "menu" for i, w in enumerate(words)), "en", "a")]
    rows += [(1002, " ".join(words + line(1).split() + words[:5]), "en", "a"), (1003, " ".join(w * 6 for w in words), "en", "a"), (1004, None, "en", "a"), (1005, "", None, None), (1005, " \n ", None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    found = rules.quality_rules(table).collect()
    assert len(found) == len(rows)
    passed = [(r.lang, r.source, r.asDict()) for r in found if not r.base_failed]
    fences = plain.rule_fences(passed, rules.MEASURES, rules.PRIOR, rules.FENCE, rules.REACH, rules.CELL_BITS)
    texts = {(i, lang, source): t for i, t, lang, source in rows if i != 1005}
    for r in found:
        n_words, word_chars, n_symbols, n_dup, n_repeat, failed = plain.rule_row(texts.get((r.doc_id, r.lang, r.source)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n_words, word_chars, n_symbols, n_dup, n_repeat, failed)
        own, broken = fences.get((r.lang, r.source), {}), []
        for m, (top, bottom, *_) in rules.MEASURES.items():
            if r[bottom] > 0 and m in own:
                value = r[top] / r[bottom]
                if value > own[m][1] or (m == "mean_word" and value < own[m][0]):
                    broken.append(m)
        assert list(r.failed_rules) == broken and r.kept == (not failed and not broken)
    only = {r.doc_id: list(r.failed_rules) for r in found if r.doc_id >= 1000 and not r.base_failed}
    assert only == {1000: ["symbol_share"], 1001: ["dup_line_share"], 1002: ["repeat_share"], 1003: ["mean_word"]}


def test_decontamination(spark, documents, texts):
    items = [("a", texts[9]), ("b", "one"), ("c", None), ("d", ""), ("e", sentence(random.Random(9), 12)), ("f", texts[10]), ("f", texts[10]), (None, texts[11])]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    own = [(i or "", t) for i, t in items]  # an item without an id hits words but isn't named
    for part_bytes in (decontamination.PART_BYTES, 2_000):
        found = decontamination.contamination(documents, benchmark, part_bytes=part_bytes).collect()
        assert len(found) == len(texts)
        for row in found:
            n_words, n_hit, held = plain.hits_row(texts[row.doc_id], own)
            assert (row.n_words, row.n_hit, sorted(row["items"])) == (n_words, n_hit, [x for x in held if x])
    clean = decontamination.remove_spans(documents, benchmark)
    want = {i: plain.without_hits(t, own) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in clean.collect()} == {i: t for i, (kept, t) in want.items() if kept}
    assert clean.columns == documents.columns
    assert decontamination.contamination(documents, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_texts_that_share_an_id(spark):
    rng = random.Random(15)
    item = sentence(rng, 14)
    rows = [(1, f"{sentence(rng, 30)} {item} {sentence(rng, 8)}", 0), (1, sentence(rng, 90), 1), (None, f"{item} {sentence(rng, 40)}", 2), (1, None, 3)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, hit_count int")
    clean = decontamination.remove_spans(documents, spark.createDataFrame([("x", item)], "item_id string, text string"))
    want = {k: plain.without_hits(t, [("x", item)])[1] for _, t, k in rows}
    assert {r.hit_count: r.text for r in clean.collect()} == want and want[0] != rows[0][1]


SCRIPTS = ["abcdefghijklmnop", "абвгдежзиклмноп", "กขคงจฉชซฌญฎฏฐฑ", "的一是不了人我在有他这中大来上", "😀😃😄😁😆😅😂🙂🙃"]


def test_line_dedup(spark):
    rng = random.Random(4)
    any_line = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    base = [any_line(rng.randint(1, 14), letters) for letters in SCRIPTS for _ in range(30)]

    def edited(line):
        out = list(line)
        for _ in range(rng.randint(1, 3)):
            out[rng.randrange(len(out))] = rng.choice("xyzé่")
        return "".join(out)

    kinds = [lambda: rng.choice(base), lambda: edited(rng.choice(base)), lambda: "  " + rng.choice(base).upper() + "\t", lambda: "", lambda: "x" * rng.randint(1, 12)]
    rows = [(i, "\n".join(rng.choice(kinds)() for _ in range(rng.randint(1, 8)))) for i in range(120)]
    rows += [(None, base[0]), (1000, None), (1001, ""), (1002, " \n\t"), (1003, base[1]), (1003, base[1])]
    documents = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, n_lines string").repartition(5)
    done = linededup.drop_repeated_lines(documents, linededup.repeated_lines(documents))
    want = plain.line_fates(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in done.collect()), key=key) == sorted(zip([i for i, _ in rows], want), key=key)
    assert done.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_removed"] and done.where("n_lines != 'keep'").count() == 0


def test_random_lines_of_any_script_stay(spark):
    rng = random.Random(16)
    rows = [(i, "\n".join("".join(rng.choice(SCRIPTS[i % 5]) for _ in range(60)) for _ in range(3))) for i in range(30)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert linededup.repeated_lines(documents).count() == 0


def test_line_links_over_a_similar_background(spark):
    rng = random.Random(17)
    words = [sentence(rng, 1) + "qr" for _ in range(690)]
    rows = []
    for i in range(20):  # pairs of long lines just above 0.8 to each other, all pairs lower
        own = list(words)
        for k in rng.sample(range(690), 36):
            own[k] = f"a{i}{k}"
        rows.append((2 * i, " ".join(own)))
        for k in rng.sample(range(690), 36):
            own[k] = f"b{i}{k}"
        rows.append((2 * i + 1, " ".join(own)))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain.line_fates(rows)
    assert sum(t != "" for t in want) == 20
    assert {r.doc_id: r.text for r in linededup.drop_repeated_lines(documents, linededup.repeated_lines(documents)).collect()} == dict(zip([i for i, _ in rows], want))


def test_hot_line_buckets_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(18)
    words = sentence(rng, 40).split()
    rows = [(i, " ".join(words[: i % 40] + [f"w{i}"] + words[i % 40 + 1 :])) for i in range(300)] + [(500 + i, sentence(rng, 12)) for i in range(100)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = {(r.id, *r.removed) for r in linededup.repeated_lines(documents).collect()}
    monkeypatch.setattr(linededup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(linededup, "HOT_SHARE", 1 / 200)
    assert {(r.id, *r.removed) for r in linededup.repeated_lines(documents).collect()} == whole and len(whole) > 200


def test_band_keys_travel_in_arrays(spark):
    rng = random.Random(20)
    rows = [(rng.randrange(400), [rng.randrange(-(1 << 62), 1 << 62) if rng.random() < 0.8 else h for h in (5, -7, 1 << 60)]) for _ in range(600)]
    rows += [(c, [rng.choice(k) for _, k in rows[:200]][:3]) for c in range(400, 500)] + [(1, [])] + rows[:50]
    lines = spark.createDataFrame(rows, "cls long, keys array<long>").repartition(3)
    pairs = [(k, c) for c, keys in rows for k in keys]
    for hot, parts in (([], 1), ([], 7), ([5, -7], 7)):
        dealt = linededup._dealt(lines, hot, parts)
        held = [(r.part, k, c) for r in dealt.collect() for k, c in zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r["classes"], np.int64).tolist())]
        assert sorted((k, c) for _, k, c in held) == sorted(pairs) and dealt.count() <= 3 * 2 * parts  # one row a part and task, not one a pair
        assert all(len({p for p, k, _ in held if k == h}) > 3 for h in hot) and len({p for p, k, _ in held if k == 1 << 60}) == 1
        many = {k for k in {k for k, _ in pairs} if len({c for x, c in pairs if x == k}) > 1}
        assert sorted((r.key, r.cls) for r in linededup._shared(dealt, parts).collect()) == sorted({(k, c) for k, c in pairs if k in many})


def test_a_text_of_many_edges_is_compared_once_and_right(spark):
    rng = random.Random(21)
    hub = sentence(rng, 30)
    texts = [hub] + [" ".join([*hub.split()[i % 12 :], sentence(rng, 1 + i % 9)]) for i in range(40)] + [sentence(rng, 30) for _ in range(5)] + ["abcdefgh", "abcdefgi"]
    edges = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if a == 0 or b % 7 == 0 or a > 40]
    found = linededup._confirmed(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 8, 80)
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    want = [(a, b) for a, b in edges if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted((r.a, r.b) for r in found.collect()) == want and 3 < len(want) < len(edges) - 3


def test_line_counts(spark):
    rows = [(0, "a\n\nb\n"), (1, ""), (2, None), (3, "a"), (4, "é\r\n字\x0b")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    done = linededup.drop_repeated_lines(documents, linededup.repeated_lines(documents))
    assert {r.doc_id: r.n_lines for r in done.collect()} == {i: len(t.split("\n")) if t is not None else 0 for i, t in rows}


def test_lines_of_texts_that_share_an_id(spark):
    rng = random.Random(19)
    a, b, c = (sentence(rng, 12) for _ in range(3))
    documents = spark.createDataFrame([(0, a), (1, f"{a}\n{b}"), (1, f"{c}\n{a}")], "doc_id long, text string")
    done = linededup.drop_repeated_lines(documents, linededup.repeated_lines(documents))
    assert sorted((r.doc_id, r.text) for r in done.collect()) == sorted([(0, a), (1, b), (1, c)])


def test_licenses(documents, texts):
    for row in licenses.license_scan(documents).collect():
        words = plain.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.fold(texts[row.doc_id] or ""))
        starts = [i for i in range(len(words)) for p in licenses.PHRASES if words[i : i + len(p.split())] == p.split()]
        assert (row.n_words, row.n_base) == (len(words), len(starts)) and (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))


def test_license_templates_across_lines(spark):
    rng = random.Random(20)
    import textwrap

    rows = []
    for i, template in enumerate(licenses.TEMPLATES.values()):
        for width in (60, 72, 80):
            around = f"{sentence(rng, rng.randint(0, 30))} {template.title() if i % 2 else template} {sentence(rng, 25)}"
            rows.append((len(rows), textwrap.fill(around, width)))
        own = template.split()
        rng.shuffle(own)
        rows.append((len(rows), " ".join(own[: len(own) * 3 // 4])))
        rows.append((len(rows), f" {sentence(rng, 9)} ".join(own)))  # all words, far apart
    for template in list(licenses.TEMPLATES.values())[:2]:  # several blocks of one template
        rows.append((len(rows), f"{template} {template} {sentence(rng, 90)} {' '.join(template.split()[3:])} {sentence(rng, 5)}"))
    rows += [(900, None), (901, ""), (902, "the of to and in this work is any a copy " * 50), (903, "x " * 40 + licenses.TEMPLATES["cc0-notice"])]
    found = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = plain.template_matches(text, licenses.TEMPLATES, licenses.THRESHOLD, licenses.STRETCH)
        assert {k: [(m.word, m.containment) for m in found[i].matches if m.label == k] for k in {m.label for m in found[i].matches}} == want and found[i].template_labels == sorted(want)
    assert all("cc0-notice" in found[i].template_labels for i, t in rows if t and "related or neighboring" in " ".join(t.lower().split()))


def test_quality_and_language_on_held_out_texts(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "mountain", "garden", "letter", "winter", "market"]) + rng.choice(["", "s"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["xqz", "zzkw", "qqq", "wvx"]) for _ in range(40))
    model = quality.train([(good(), 1) for _ in range(100)] + [(bad(), 0) for _ in range(100)])
    rows = spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(40)] + [(100, None), (101, "")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality.score_documents(rows, model).collect()}
    assert all((scores[i] > 0.7) == bool(i % 2) for i in range(40)) and 0 <= scores[100] <= 1 and scores[100] == scores[101]
    samples = {"en": ["the house and the garden of the old town are with them"] * 20, "de": ["das haus und der garten der alten stadt sind bei ihnen"] * 20}
    held = language.train(samples, language.Pieces.load())
    asked = spark.createDataFrame([(1, "the town and the house"), (2, "der garten und das haus"), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(asked, held).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}


def test_language_of_unspaced_texts_and_after_long_words():
    rng = random.Random(7)
    han = lambda s: "".join(rng.choice(s) for _ in range(60))
    samples = {"a": [han("的一是不了人我在有他") for _ in range(20)], "b": [han("這中大來上國個到說們") for _ in range(20)], "en": ["the house and the garden"] * 20}
    model = language.train(samples, language.Pieces.load())
    texts = [han("的一是不了人我在有他"), han("這中大來上國個到說們"), "的" * 3000, "這" * 3000, "z" * 3000, "the garden and the house", han("的一是不了人我在有他")]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    assert np.isfinite(model.log_likelihoods(data, offsets)).all()
    found, scores = model.predict(data, offsets)
    assert found[:4] == ["a", "b", "a", "b"] and found[5:] == ["en", "a"] and np.isfinite(scores).all()


def test_the_forward_algorithm_sums_all_segmentations():
    pieces = language.Pieces([b" a", b"ab", b"abc", b" abca", b"ca", b"b", b" abcabcabcabcabcabcabca"])
    rng = np.random.default_rng(3)
    probability = rng.random((len(pieces.pieces), 3))
    numbers = {p: i for i, p in enumerate(pieces.pieces)}

    def total(word):
        if not word:
            return np.ones(3)
        return sum((probability[numbers[word[:k]]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in numbers), np.zeros(3))

    words = [b"a", b"abc", b"abcab", b"cab", b"bbb", b"abcabcabcabcabcabcabca"[:14]]
    data, offsets = np.frombuffer(b" ".join(words), dtype=np.uint8), np.array([0, len(b" ".join(words))])
    model = language.Model(["x", "y", "z"], pieces, probability)
    assert np.allclose(model.log_likelihoods(data, offsets)[0], sum(np.log(total(b" " + w)) for w in words))
    assert np.allclose(model.log_likelihoods(data, offsets)[0], sum(np.log(total(b" " + w)) for w in words))  # from the table of scored words


def test_languages_of_long_words_stay_finite():
    samples = {"a": ["a" * 30] * 5, "b": ["b" * 30] * 5}
    model = language.train(samples, language.Pieces.load())
    raw = [("a" * 200 + " " + "b" * 200).encode(), ("a" * 9000).encode()]
    found, scores = model.predict(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    assert found[1] == "a" and ((scores >= 0) & (scores <= 1)).all()


def test_samples_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * (10 ** (i % 6))) for i in range(60)], "id long, text string")
    from ridgeline.llm.storage import within_bytes

    found = within_bytes(rows, "text", 20_000)
    assert 0 < sum(len(r.text) for r in found) <= 20_000
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert sum(len(t) for t, _ in quality.training_rows(rows.withColumnRenamed("id", "doc_id"), labels, F.lit(True), most_bytes=3_000)) <= 3_000


def test_packing(spark, documents, texts):
    lengths, counts = np.array([1, 2, 3, 10, 11, 50]), np.array([5, 1, 1, 7, 2, 1])
    ends, padding = packing.optimal_boundaries(lengths, counts, 3)

    def cost(cut):
        return sum(c * (min(e for e in cut if e >= n) - n) for n, c in zip(lengths, counts, strict=True))

    assert padding == min(cost((*x, 50)) for x in itertools.combinations([1, 2, 3, 10, 11], 2)) == cost(ends)
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.choice(5000, 7, replace=False) + 1
        counts, k = rng.integers(1, 9, 7), int(rng.integers(1, 6))
        ends, padding = packing.optimal_boundaries(lengths, counts, k)
        top = max(lengths)
        assert padding == cost(ends) == min(cost((*x, top)) for x in itertools.combinations(sorted(set(lengths) - {top}), k - 1)) and len(ends) <= k
    rows = packing.pack(documents, budget=200).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.batch_id, []).append(r.bucket_tokens)
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
    assert all(len(set(b)) == 1 and (len(b) == 1 or sum(b) <= 200) for b in sizes.values())


def test_packing_of_equal_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    rows = spark.createDataFrame([(7 if i % 3 else None, "w " * (i % 5 and 1500 + i % 7)) for i in range(200)], "doc_id long, text string").repartition(4)
    found = packing.pack(rows, buckets=3, budget=6_000).collect()
    assert len(found) == 200 and len({(r.batch_id, r.slot) for r in found}) == 200
    bound = {r.bucket_tokens for r in found}
    counts = [r.n_tokens for r in found]
    _, padding = packing.optimal_boundaries(*np.unique([n for n in counts if n], return_counts=True), 3)
    assert sum(r.padding for r in found) == padding and 0 in bound and len(bound) <= 4
    sizes = {}
    for r in found:
        sizes.setdefault((r.bucket_tokens, r.batch_id), []).append(r.slot)
    for e in bound - {0}:
        full = sorted((len(s) for (b, _), s in sizes.items() if b == e), reverse=True)
        assert all(n == 6_000 // e for n in full[:-1]) and all(sorted(s) == list(range(len(s))) for s in sizes.values())


def plain_revisit(own, every):
    """(outcome, record id referred to, merged headers) by looking at every record."""
    get = lambda hs, name: next((h["value"] for h in hs or [] if h["name"].lower() == name), None)
    earlier = [r for r in every if own["url"] is not None and own["date"] is not None and r["type"] == "response" and r["status"] == 200 and r["url"] == own["url"] and r["date"] is not None and r["date"] < own["date"]]
    if not earlier:
        return "missing", None, own["headers"]
    full = max(earlier, key=lambda r: (r["date"], r["id"]))
    tags = [get(h, "etag") and get(h, "etag").strip().removeprefix("W/") for h in (own["headers"], full["headers"])]
    dates = [get(h, "last-modified") for h in (own["headers"], full["headers"])]
    same = tags[0] == tags[1] if None not in tags else dates[0] == dates[1] if None not in dates else None
    if same is False:
        return "mismatch", None, own["headers"]
    allowed = [h for h in own["headers"] or [] if h["name"].lower() in warc.PERMITTED]
    names = {h["name"].lower() for h in allowed}
    merged = [h for h in full["headers"] or [] if h["name"].lower() not in names] + allowed
    return "unverified" if same is None else "resolved", full["id"], sorted(({"name": h["name"].lower(), "value": h["value"]} for h in merged), key=lambda h: (h["name"], h["value"]))


def test_revisits(spark):
    import datetime

    rng = random.Random(21)
    tag = lambda: rng.choice(['"a"', 'W/"a"', '"b"', None])
    records = []
    for i in range(400):
        headers = [{"name": n, "value": v} for n, v in (("ETag", tag()), ("Last-Modified", rng.choice(["mon", "tue", None])), ("Cache-Control", f"max-age={i}"), ("Set-Cookie", "x=y"), ("Date", rng.choice([None, "now"]))) if v]
        url = rng.choice(["h.a/x"] * 6 + ["h.a/y", "h.a/z", None])
        date = rng.choice([None] + [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(60))] * 12)
        records.append({"id": i, "url": url, "date": date, "type": rng.choice(["response", "revisit"]), "status": rng.choice([200, 200, 404]), "headers": rng.choice([headers] * 9 + [None])})
    schema = "record_id long, url string, warc_date timestamp, warc_type string, status int, headers array<struct<name:string,value:string>>, full string, part int"
    rows = [(r["id"], r["url"] and f"https://WWW.{r['url']}?utm_source=q#f", r["date"], r["type"], r["status"], r["headers"] and [(h["name"], h["value"]) for h in r["headers"]], "x", 1) for r in records]
    table = spark.createDataFrame(rows, schema)
    found = {r.record_id: r for r in warc.resolve_revisits(table).collect()}
    assert set(found) == {r["id"] for r in records if r["type"] == "revisit"}
    outcomes = set()
    for r in records:
        if r["type"] == "revisit":
            outcome, refers_to, headers = plain_revisit(r, records)
            row = found[r["id"]]
            held = row.headers and [h.asDict() for h in row.headers]
            assert (row.outcome, row.refers_to, held) == (outcome, refers_to, headers)
            outcomes.add(outcome)
    assert outcomes == {"resolved", "unverified", "mismatch", "missing"}
    assert warc.resolve_revisits(table.limit(0)).count() == 0


def test_empty_tables(documents):
    empty = documents.limit(0)
    assert neardup.near_duplicates(empty).count() == 0 and rules.quality_rules(empty).count() == 0 and packing.pack(empty).count() == 0
    assert secrets.secret_scan(empty, secrets.learn(empty)).count() == 0 and licenses.license_scan(empty).count() == 0
    assert linededup.drop_repeated_lines(empty, linededup.repeated_lines(empty)).count() == 0
    benchmark = empty.select(F.col("source").alias("item_id"), "text")
    assert decontamination.contamination(empty, benchmark).count() == 0 and decontamination.remove_spans(empty, benchmark).count() == 0
    model = language.train(language.training_texts(empty, F.lit(True)), language.Pieces.load())
    assert language.identify(empty, model).count() == 0 and {r.lang_pred for r in language.identify(documents, model).collect()} == {"und"}
    scored = quality.score_documents(documents, quality.train(quality.training_rows(empty, empty.selectExpr("doc_id", "bucket AS quality"), F.lit(True))))
    assert {round(r.score, 6) for r in scored.collect()} == {0.5}


def plain_pipeline(spark, folder):
    """The documents left before packing, stage by stage without Spark, but for the trained model."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(quality.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True)))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dup", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    score = lambda t: model.scores(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0]
    inked = lambda rows: {i: t for i, t in rows.items() if t and t.strip(" \t\n\v\f\r")}
    rows = {i: t for i, t in inked(rows).items() if score(t) >= quality.THRESHOLD}
    rows = inked(dict(zip(rows, plain.line_fates(list(rows.items())))))
    of = plain.near_duplicate_components(rows, neardup.SHINGLE)
    rows = {i: t for i, t in rows.items() if of[i] == i}
    cut = {i: plain.without_hits(t, items) for i, t in rows.items()}
    return inked({i: t for i, (kept, t) in cut.items() if kept})


def test_the_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, folder).collect()
    want = plain_pipeline(spark, folder)
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(plain.re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in want.items()} and len(found) == len(want)
    _, padding = packing.optimal_boundaries(*np.unique([r.n_tokens for r in found], return_counts=True), packing.BUCKETS)
    assert sum(r.padding for r in found) == padding
    assert all(n * size <= packing.BUDGET or n == 1 for (_, size), n in Counter((r.batch_id, r.bucket_tokens) for r in found).items())


def test_the_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(3).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    odd = odd.withColumns({"gone": F.lit(1), "score": F.lit("x"), "component_id": F.lit(2), "batch_id": F.lit(3)})
    for name, rows in (("odd", odd), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        count = corpus_pipeline.run(spark, folder).count()
        assert count == 0 if name == "none" else count > 0
