"""Plain versions of what the operators compute, document by document, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secret_row(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()


def rule_row(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_duplicate_components(texts: dict[int, str | None], size: int, percent: int = 80) -> dict[int, int]:
    """Every pair compared; the smallest id of each component."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    held: dict = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def hits_row(text: str | None, items: list[tuple[str, str]], size: int = 10) -> tuple[int, int, list[str]]:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    words, hit, found = split(text), set(), set()
    for item, own in items:
        w = split(own)
        k = min(size, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if windows and tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), sorted(found)


def line_fates(rows: list[tuple[int | None, str | None]], size: int = 8, percent: int = 80) -> list[str | None]:
    """Each row's text without repeated lines: every pair of different lines of the corpus is compared.

    Of each component the line of the smallest (id, order of the row's text among the texts of its id, number) stays;
    here rows of one id must have one text each.
    """
    strip = lambda x: fold(x.strip(" \t\n\v\f\r"))
    first: dict[str, tuple[int, int]] = {}
    for i, text in rows:
        if i is not None and text is not None:
            for k, line in enumerate(text.split("\n")):
                if strip(line):
                    first[strip(line)] = min((i, k), first.get(strip(line), (i, k)))
    sets = {x: {x[k : k + size] for k in range(max(1, len(x) - size + 1))} if len(x) >= size else {(x,)} for x in first}
    parent = {x: x for x in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets, key=lambda x: len(sets[x]))
    for j, b in enumerate(order):  # a smaller set of less than 0.8 of the size can't be similar enough
        for i in range(j - 1, -1, -1):
            a = order[i]
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    keeper: dict[str, tuple[int, int]] = {}
    for x, at in first.items():
        keeper[root(x)] = min(at, keeper.get(root(x), at))

    def fate(i, text):
        if i is None or text is None:
            return text
        lines = text.split("\n")
        left = [line for k, line in enumerate(lines) if not strip(line) or keeper[root(strip(line))] == (i, k)]
        if len(left) == len(lines):
            return text
        return "\n".join(left) if strip("\n".join(left)) else ""

    return [fate(i, text) for i, text in rows]


def rule_fences(rows: list[tuple], measures: dict, prior: int, fence: float, reach: float, bits: int) -> dict:
    """(lang, source) -> measure -> (low, high) from rows (lang, source, counts by name) that pass the base rules."""
    cell = lambda v: v >> max(v.bit_length() - bits, 0) << max(v.bit_length() - bits, 0)
    own: dict = {}
    for lang, source, counts in rows:
        for m, (top, bottom, steps, *_) in measures.items():
            if counts[bottom] > 0:
                own.setdefault((lang, source, m), Counter())[cell(counts[top] * steps // counts[bottom])] += 1
    out: dict = {}
    for (lang, source, m), held in own.items():
        of_lang = sum((c for (other, _, k), c in own.items() if (other, k) == (lang, m)), Counter())
        total = sum(of_lang.values())
        weight = {c: held[c] * total + prior * n for c, n in of_lang.items()}
        _, _, steps, least, limit = measures[m]

        def quantile(quarters, weight=weight, steps=steps):
            upto = 0
            for c in sorted(weight):
                upto += weight[c]
                if upto * 4 >= sum(weight.values()) * quarters:
                    return c / steps

        low, high = quantile(1), quantile(3)
        width = fence * max(high - low, least)
        out.setdefault((lang, source), {})[m] = (low - width, high + (width if limit is None else min(width, (limit - high) * reach)))
    return out


def template_matches(text: str | None, templates: dict[str, str], threshold: float, stretch: float) -> dict[str, list[tuple[int, float]]]:
    """label -> (first word, containment) of its blocks, the best first, none overlapping a better one; every window that starts with one of its words is tried."""
    import math

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
    out: dict = {}
    for label, template in templates.items():
        own = set(template.split())
        width = math.ceil(stretch * len(template.split()) - 1e-9)
        found = []
        for i, w in enumerate(words):
            common = len(own & set(words[i : i + width])) if w in own else 0
            if common and common >= math.ceil(threshold * len(own) - 1e-9):
                found.append((-common / len(own), i))
        for below, i in sorted(found):
            if all(abs(i - k) >= width for k, _ in out.get(label, ())):
                out.setdefault(label, []).append((i, -below))
    return out


def without_hits(text: str | None, items: list[tuple[str, str]], size: int = 10, drop_share: float = 0.5) -> tuple[bool, str | None]:
    """(kept, text without the spans of words that lie in windows of the items)."""
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))]
    lowered = fold(text or "")
    words = [lowered[a:b] for a, b in places]
    hit = set()
    for _, own in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(own or ""))
        k = min(size, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if windows and tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
    if not hit:
        return True, text
    out, at = [], 0
    for i in sorted(hit):
        a = places[i][0] if i - 1 not in hit else places[i - 1][1]  # what lies between two hit words goes too
        out.append(text[at:a] if a > at else "")
        at = places[i][1]
    return len(hit) <= drop_share * len(words), "".join(out) + text[at:]


def collocation_rows(rows: list[tuple[str | None, str | None]], longest: int = 3, least: int = 10, absorbed: int = 50, top: int = 2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from rows (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + size]) for (lang, p), f in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1) if 100 * f >= absorbed * counts[lang, p[i : i + size]]}
    out = []
    for lang in totals:
        scored = []
        for (of, p), a in candidates.items():
            if of == lang and (of, p) not in gone:
                score, k = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return out


def one_edit_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_words(rows: list[tuple], least_length: int = 6, least: int = 5, one_in: int = 199) -> dict[str, int]:
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least_length
    return {w: n for w, n in found.items() if n >= least and len(w) >= least_length}


def spelling_rows(words: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    """word -> (n, n_near, form, form_n, root); every pair of words is compared."""
    near = {w: [x for x in words if one_edit_apart(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def kept_words(rows: list[tuple], window: int = 50) -> list[tuple[int, int, str]]:
    """(words, words removed, text left) of each row (id, text)."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    first: dict = {}
    for (i, _), words in zip(rows, split):
        for k in range(len(words) - window + 1 if i is not None else 0):
            w = tuple(words[k : k + window])
            first[w] = min(i, first.get(w, i))
    out = []
    for (i, _), words in zip(rows, split):
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out
