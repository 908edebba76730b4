"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import rules
from .licenses import PHRASES, STRETCH, TEMPLATES, THRESHOLD

#: Lower-cased words of digits, letters and characters beyond ASCII.
_WORDS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FOLD = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = _WORDS.format(text=_FOLD.format(text="text"))

NEARDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS s FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), rare AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT * FROM shingles SEMI JOIN rare USING (s)) a JOIN (SELECT * FROM shingles SEMI JOIN rare USING (s)) b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN found USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_PLAIN} AS w FROM documents
), items AS (SELECT item_id, {_PLAIN} AS w FROM benchmark
), sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS win FROM sized
), sizes AS (SELECT DISTINCT k FROM windows
), places AS (
  SELECT doc_id, k, unnest(generate_series(1, len(w) - k + 1)) AS i, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS win
  FROM docs, sizes WHERE len(w) >= k
), hits AS (SELECT doc_id, item_id, i, places.k AS k FROM places JOIN windows ON places.win = windows.win AND places.k = windows.k
), hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _licenses() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES.items())
    return f"""
WITH phrases(phrase, label) AS (VALUES {phrases}
), templates(label, words, width) AS (SELECT label, list_distinct(string_split(t, ' ')), ceil({STRETCH} * len(string_split(t, ' ')) - 1e-9) FROM (VALUES {templates}) v(label, t)
), docs AS (SELECT doc_id, {_FOLD.format(text="text")} AS t, {_PLAIN} AS w FROM documents
), places AS (
  SELECT doc_id, label, i - 1 AS word
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs WHERE regexp_matches(t, 'license|cc')) JOIN phrases ON array_to_string(list_slice(w, i, i + len(string_split(phrase, ' ')) - 1), ' ') = phrase
), base AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), wanted AS (SELECT label, unnest(words) AS word FROM templates
), held AS (SELECT doc_id, label, i, h.word FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM docs) h JOIN wanted USING (word)
), blocks AS (
  SELECT a.doc_id, a.label, a.i, count(DISTINCT b.word) AS common FROM held a JOIN templates USING (label) JOIN held b ON b.doc_id = a.doc_id AND b.label = a.label AND b.i >= a.i AND b.i < a.i + width
  GROUP BY a.doc_id, a.label, a.i
), matched AS (
  SELECT doc_id, label, max(common / len(words)) AS containment FROM blocks JOIN templates USING (label) WHERE common >= ceil({THRESHOLD} * len(words) - 1e-9) GROUP BY doc_id, label
), learnt AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS containment FROM matched GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(learnt.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN learnt USING (doc_id)
"""


WARC = r"""
WITH keyed AS (
  SELECT page_id, md5(html) AS digest, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), parts AS (
  SELECT page_id, digest, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
    regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '\?.*$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(regexp_replace(bare, '^[^/?]*', ''), '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND regexp_extract(p, '^([^=]*)', 1) NOT IN ('ref', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'sessionid'))) AS params
  FROM keyed
), pages2 AS (
  SELECT page_id, digest, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key,
    page_id * 7919 % 2592000 AS fetched, 'day-' || (page_id % 9)::VARCHAR AS modified FROM parts
), earlier AS (
  SELECT r.page_id, r.url_key, r.modified, r.digest, f.page_id AS full_id, f.digest AS full_digest, f.modified AS full_modified,
    row_number() OVER (PARTITION BY r.page_id ORDER BY f.fetched DESC, f.page_id DESC) AS rn
  FROM pages2 r JOIN pages2 f ON f.url_key = r.url_key AND f.fetched < r.fetched + 86400
), judged AS (
  SELECT page_id, url_key, full_id, full_digest, full_modified, digest,
    CASE WHEN page_id % 11 = 0 THEN 'unverified'
      WHEN page_id % 7 = 0 THEN CASE WHEN modified = full_modified THEN 'resolved' ELSE 'mismatch' END
      WHEN page_id % 3 = 0 THEN CASE WHEN 'new-' || digest = full_digest THEN 'resolved' ELSE 'mismatch' END
      WHEN digest = full_digest THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM earlier WHERE rn = 1
)
SELECT page_id, url_key, outcome, CASE WHEN outcome <> 'mismatch' THEN full_id END AS refers_to,
  CASE WHEN outcome <> 'mismatch' THEN 'cache-control=max-age=900;content-type=text/html;etag=' ||
    CASE WHEN page_id % 11 = 0 OR page_id % 7 = 0 THEN '"' || full_digest || '"' WHEN page_id % 3 = 0 THEN '"new-' || digest || '"' ELSE 'W/"' || digest || '"' END || ';last-modified=' || full_modified END AS headers
FROM judged
"""


def _rules() -> str:
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {top} * {steps} // {bottom} AS value FROM counted WHERE NOT base_failed AND {bottom} > 0" for m, (top, bottom, steps, *_) in rules.MEASURES.items())
    fences, broken = [], []
    for m, (_, _, steps, least, limit) in rules.MEASURES.items():
        q1, q3 = (f"max(CASE WHEN measure = '{m}' THEN {q} END) / {float(steps)}" for q in ("q1", "q3"))
        width = f"{rules.FENCE} * greatest(({q3}) - ({q1}), {least})"
        above = width if limit is None else f"least({width}, ({limit} - ({q3})) * {rules.REACH})"
        fences.append(f"({q1}) - ({width}) AS low_{m}, ({q3}) + ({above}) AS high_{m}")
        top, bottom = rules.MEASURES[m][:2]
        below = f" OR {top} / {bottom} < low_{m}" if m == "mean_word" else ""
        broken.append(f"CASE WHEN {bottom} > 0 AND ({top} / {bottom} > high_{m}{below}) THEN '{m}' END")
    return f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs)
), twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 4) g(k) GROUP BY doc_id
), lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < {rules.MIN_WORDS} OR 100 * coalesce(n, 0) > {rules.MAX_REPEAT_PERCENT} * len(w) AS base_failed
  FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
), vals AS ({values}
), spared AS (SELECT *, greatest(length(bin(value)) - {rules.CELL_BITS}, 0)::BIGINT AS spare FROM vals
), own AS (SELECT lang, source, measure, (value >> spare) << spare AS cell, count(*) AS n FROM spared GROUP BY ALL
), by_lang AS (SELECT lang, measure, cell, sum(n)::HUGEINT AS m FROM own GROUP BY ALL
), every AS (SELECT DISTINCT lang, source, measure FROM own
), weighed AS (
  SELECT e.lang, e.source, e.measure, b.cell, coalesce(o.n, 0)::HUGEINT * (sum(b.m) OVER (PARTITION BY e.lang, e.source, e.measure))::HUGEINT + {rules.PRIOR} * b.m AS weight
  FROM every e JOIN by_lang b ON e.lang IS NOT DISTINCT FROM b.lang AND e.measure = b.measure
  LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM e.lang AND o.source IS NOT DISTINCT FROM e.source AND o.measure = e.measure AND o.cell = b.cell
), summed AS (
  SELECT lang, source, measure, cell, (sum(weight) OVER (PARTITION BY lang, source, measure ORDER BY cell ROWS UNBOUNDED PRECEDING))::HUGEINT AS upto, (sum(weight) OVER (PARTITION BY lang, source, measure))::HUGEINT AS total FROM weighed
), quartiles AS (SELECT lang, source, measure, min(CASE WHEN upto * 4 >= total THEN cell END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN cell END) AS q3 FROM summed GROUP BY ALL
), fences AS (SELECT lang, source, {", ".join(fences)} FROM quartiles GROUP BY lang, source
), judged AS (
  SELECT c.*, array_to_string(list_filter([{", ".join(broken)}], lambda x: x IS NOT NULL), ',') AS failed_rules
  FROM counted c LEFT JOIN fences f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM judged
"""


_SPLIT = "regexp_split_to_array(" + _FOLD.format(text="text") + r", '[.,;:!?\x0A-\x0D]')"

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest({_SPLIT}) AS piece FROM documents)
), f1 AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS phrase FROM pieces) GROUP BY ALL
), f2 AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM pieces) GROUP BY ALL
), f3 AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM pieces) GROUP BY ALL
), total AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang
), cut AS (
  SELECT lang, phrase, f, split_part(phrase, ' ', 1) AS x, split_part(phrase, ' ', 2) AS y, 1 AS k FROM f2 WHERE f >= 10
  UNION ALL SELECT lang, phrase, f, split_part(phrase, ' ', 1), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), 1 FROM f3 WHERE f >= 10
  UNION ALL SELECT lang, phrase, f, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3), 2 FROM f3 WHERE f >= 10
), parts AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2
), scored AS (
  SELECT cut.lang, cut.phrase, cut.f AS a, l.f AS l, r.f AS r, k, (1000000::HUGEINT * cut.f * cut.f) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN parts l ON l.lang = cut.lang AND l.phrase = x JOIN parts r ON r.lang = cut.lang AND r.phrase = y
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase FROM f3 WHERE f >= 10
    UNION ALL SELECT lang, f, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM f3 WHERE f >= 10) GROUP BY ALL
), kept AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank
  FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept JOIN total USING (lang) WHERE rank <= 2000
"""


def _crc_of_nibble(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


#: The crc32 of a string, four bits at a time.
_CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({{text}}) * 2), lambda j: (strpos('0123456789ABCDEF', hex(encode({{text}}))[xor(j, 1) + 1]) - 1)::BIGINT)),
  lambda c, b: xor(c >> 4, {[_crc_of_nibble(i) for i in range(16)]}[(xor(c, b) & 15) + 1])), 4294967295)"""

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6
), counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS times FROM runs GROUP BY ALL
), hashed AS (SELECT run, times, {_CRC.format(text="named")} AS h FROM counted
), cut AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), words AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), variants AS (SELECT word, i, substring(word, 1, i::INT) || substring(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), shorter AS (SELECT DISTINCT v.word AS a, w.word AS b FROM variants v JOIN words w ON v.rest = w.word
), near AS (
  SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
  UNION SELECT x.word, y.word FROM variants x JOIN variants y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
), best AS (
  SELECT a AS word, b AS form, n AS form_n, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN words ON words.word = b
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1
), found AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at, form AS next FROM found UNION ALL SELECT chain.word, found.word, found.form FROM chain JOIN found ON found.word = chain.next
)
SELECT found.word, found.form, chain.at AS root, found.n, found.n_near, found.form_n FROM found JOIN chain ON chain.word = found.word AND chain.next IS NULL
"""

SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)
), earliest AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s HAVING count(*) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN earliest USING (s) WHERE m < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op3_neardup": NEARDUP, "op4_rules": _rules(), "op5_decontamination": DECONTAMINATION, "op8_licenses": _licenses(), "op9_warc": WARC, "op11_collocations": COLLOCATIONS, "op12_spelling": SPELLING, "op13_substrings": SUBSTRINGS}
