"""Secret scans: base patterns, plus formats learnt by grammar inference from labelled credentials.

The labelled credentials are the base patterns' matches in all documents.  Per kind they form a prefix tree over
character classes; statistically compatible states are merged (state merging by Hoeffding bounds) into a
probabilistic automaton.  Every other candidate token of a text is scored by how much likelier a kind's
automaton makes it than what else it may be: an ordinary token, by an automaton inferred from the documents'
tokens that are no credentials, or a plain run of one class of characters.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch

#: The base patterns, with the least length of what must be long enough, in the order in which ties of a start are listed.
BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: The kind of the spans that only the automata find.
LEARNT = "learnt"
_KEYWORD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")

#: Candidates of the learnt formats have at least as many characters.
LEAST_CANDIDATE = 6
#: Bounds of what is learnt from: distinct credentials kept per kind, distinct ordinary tokens kept, by hash of all there are.
MOST_CREDENTIALS, MOST_ORDINARY = 2_000, 4_000
#: Confidence of the merge test.
ALPHA = 0.05
#: Log-likelihood ratio from which a candidate is reported: the mean a symbol, and in all.
LEAST_RATIO, LEAST_TOTAL = 0.7, 12.0
#: In a plain run the next symbol is the same with this probability, else any of the others.
RUN = 0.7
#: A state's unseen symbols share this probability.
UNSEEN = 1e-3

_HEX = K.byte_class((0x30, 0x39), (0x61, 0x66))
_TOKEN = K.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *[(ord(c),) * 2 for c in "+/_.=-"])
_PART = K.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *[(ord(c),) * 2 for c in "+_-"])
_ALNUM = K.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: Tokens that are scored one by one once fewer than this many of a block are as long.
_FEW = 16


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the base patterns' matches that are long enough, by start, then kind as listed."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        if kind == "hex":  # maximal runs: shorter ones need not be visited
            pattern = _LONG_HEX
        found += [(m.start(), rank, m.end(), kind, m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [(start, end, kind, secret) for start, _, end, kind, secret in sorted(found, key=lambda x: x[:2])]


_LONG_HEX = re.compile(rf"[0-9a-f]{{{BASE['hex'][2]},}}")


def symbols(token: str) -> str:
    """Character classes of a token: 0 for digits, x/X for a-f/A-F, z/Z for other letters, the rest as they are."""
    return token.translate(_CLASSES)


#: Fixed value: the symbols.
SYMBOLS = "0xzXZ+/_.=-"
_CLASSES = str.maketrans({**{c: "0" for c in "123456789"}, **{c: "x" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEF"}, **{c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}})


@dataclass
class _State:
    ends: int = 0
    visits: int = 0
    count: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states of their prefix tree.

    First states of equal depth are merged, from the root down: strings of free choice branch so much that a deep
    state of the tree has seen one string or two, too few to tell it from any other.  What is left, one state
    or a few for each place in a format, has seen enough to tell places apart and is merged across depths.  Without
    ``places`` only the latter is done, which leaves few states: they can't keep the format of a few strings among many.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA, places: bool = True):
        self.states = [_State()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            self._add(s)
        self._into = list(range(len(self.states)))
        if places:
            self._merge_depths()
        self._merge_all()

    def _add(self, string: str) -> None:
        at = self.states[0]
        at.visits += 1
        for c in string:
            if c not in at.to:
                at.to[c] = len(self.states)
                self.states.append(_State())
            at.count[c] = at.count.get(c, 0) + 1
            at = self.states[at.to[c]]
            at.visits += 1
        at.ends += 1

    def _find(self, i: int) -> int:
        while self._into[i] != i:
            self._into[i] = self._into[self._into[i]]
            i = self._into[i]
        return i

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two states, and those that equal symbols lead to from them, end and go on alike."""
        todo, seen = [(a, b)], set()
        while todo:
            i, j = map(self._find, todo.pop())
            if i == j or (i, j) in seen:
                continue
            seen.add((i, j))
            p, q = self.states[i], self.states[j]
            if not p.visits or not q.visits:
                continue
            if self._differ(p.ends, p.visits, q.ends, q.visits):
                return False
            for c in {*p.to, *q.to}:
                if self._differ(p.count.get(c, 0), p.visits, q.count.get(c, 0), q.visits):
                    return False
                if c in p.to and c in q.to:
                    todo.append((p.to[c], q.to[c]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Make b one state with a, and the states that equal symbols lead to likewise."""
        todo = [(a, b)]
        while todo:
            i, j = map(self._find, todo.pop())
            if i == j:
                continue
            self._into[j] = i
            p, q = self.states[i], self.states[j]
            p.ends += q.ends
            p.visits += q.visits
            for c, n in q.count.items():
                p.count[c] = p.count.get(c, 0) + n
            for c, t in q.to.items():
                if c in p.to:
                    todo.append((p.to[c], t))
                else:
                    p.to[c] = t

    def _next(self, states: list[int]) -> list[int]:
        """The states one symbol on, each once, in a fixed order."""
        return list(dict.fromkeys(self._find(self.states[i].to[c]) for i in states for c in sorted(self.states[i].to)))

    def _merge_depths(self) -> None:
        level = [0]
        while level := sorted(self._next(level), key=lambda i: -self.states[i].visits):
            kept: list[int] = []
            for new in level:
                if self._find(new) != new:
                    continue
                twin = next((r for r in kept if self._compatible(r, new)), None)
                if twin is None:
                    kept.append(new)
                else:
                    self._merge(twin, new)
            level = kept

    def _merge_all(self) -> None:
        red = [0]
        while True:
            new = next((x for x in self._next(red) if x not in red), None)
            if new is None:
                break
            twin = next((r for r in red if self._compatible(r, new)), None)
            if twin is None:
                red.append(new)
            else:
                self._merge(twin, new)
                red = list(dict.fromkeys(map(self._find, red)))
        numbers = {r: i for i, r in enumerate(red)}
        self.states = [_State(x.ends, x.visits, x.count, {c: numbers[self._find(t)] for c, t in x.to.items()}) for x in (self.states[r] for r in red)]

    def log_likelihood(self, string: str) -> float:
        """Natural log of the string's probability; a symbol that a state has not seen costs UNSEEN and leads back to the start."""
        total, at = 0.0, self.states[0]
        for c in string:
            n = at.count.get(c, 0)
            total += math.log((n / at.visits) * (1 - UNSEEN) if n else UNSEEN)
            at = self.states[at.to[c]] if n else self.states[0]
        return total + math.log(max(at.ends / at.visits if at.visits else 0, UNSEEN))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same as arrays: (states x symbols) costs and next states, each state's cost of ending, and the first state."""
        cost = np.full((len(self.states), len(SYMBOLS)), math.log(UNSEEN))
        to, end = np.zeros(cost.shape, dtype=np.int64), np.full(len(self.states), math.log(UNSEEN))
        for i, state in enumerate(self.states):
            end[i] = math.log(max(state.ends / state.visits if state.visits else 0, UNSEEN))
            for c, n in state.count.items():
                if c in SYMBOLS and n:
                    cost[i, SYMBOLS.index(c)], to[i, SYMBOLS.index(c)] = math.log(n / state.visits * (1 - UNSEEN)), state.to[c]
        return cost, to, end, 0


class Formats:
    """An automaton for each kind with enough labelled credentials, one for ordinary tokens, and plain runs."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.kinds = {kind: Automaton([symbols(s) for s in found]) for kind, found in sorted(labelled.items()) if found}
        n = len(SYMBOLS)
        same, other = math.log(RUN), math.log((1 - RUN) / (n - 1))
        run = (np.array([[same if s == c else other for c in range(n)] for s in range(n)] + [[-math.log(n)] * n]), np.tile(np.arange(n), (n + 1, 1)), np.full(n + 1, 0.0), n)
        # (log-probability, next state, log-probability to end, first state): ordinary tokens and runs, then the kinds
        self.tables = [Automaton([symbols(s) for s in ordinary], places=False).table(), run, *(a.table() for a in self.kinds.values())]
        self.rows = [(cost.tolist(), to.tolist(), end.tolist(), start) for cost, to, end, start in self.tables]

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each token data[starts:ends], the best kind's log-likelihood ratio; -inf without kinds."""
        if not self.kinds:
            return np.full(len(starts), -np.inf)
        order = np.argsort(ends - starts, kind="stable")[::-1]
        starts, lengths = starts[order], (ends - starts)[order]
        own = np.empty((len(self.tables), len(order)))
        codes = _CODES[data]
        for t, (cost, to, end, first) in enumerate(self.tables):
            state, total, n, j = np.full(len(order), first), np.zeros(len(order)), len(order), 0
            while True:
                n = int(np.searchsorted(-lengths, -j, "left"))  # tokens of more than j symbols
                if n < _FEW:
                    break
                c = codes[starts[:n] + j]
                total[:n] += cost[state[:n], c]
                state[:n] = to[state[:n], c]
                j += 1
            costs, targets = self.rows[t][:2]
            for i in range(n):
                s, x = int(state[i]), float(total[i])
                for c in codes[starts[i] + j : starts[i] + lengths[i]].tolist():
                    x += costs[s][c]
                    s = targets[s][c]
                state[i], total[i] = s, x
            own[t] = total + end[state]
        out = np.empty(len(order))
        out[order] = own[2:].max(axis=0) - own[:2].max(axis=0)
        return out

    def score(self, token: str) -> float:
        """The best kind's log-likelihood ratio of one token."""
        data = np.frombuffer(token.encode(), dtype=np.uint8)
        return float(self.scores(data, np.array([0]), np.array([len(data)]))[0])


_CODES = np.zeros(256, dtype=np.int64)
for _byte in range(128):
    _CODES[_byte] = max(0, SYMBOLS.find(symbols(chr(_byte))))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the candidates of a block, as byte offsets: maximal runs of ``[A-Za-z0-9+/_.=-]``, from
    their first letter or digit to their last, and the parts between their ``=``, ``/`` and ``.``."""
    inked = np.flatnonzero(_ALNUM[data])
    found = []
    for inside in (_TOKEN, _PART):
        starts, ends = K.runs(inside[data], offsets)
        a, b = np.searchsorted(inked, starts), np.searchsorted(inked, ends)
        some = np.flatnonzero(b > a)
        found.append(np.stack([inked[a[some]], inked[b[some] - 1] + 1]))
    spans = np.concatenate(found, axis=1)
    spans = spans[:, spans[1] - spans[0] >= LEAST_CANDIDATE]
    order = np.lexsort((spans[1], spans[0]))
    spans = spans[:, order]
    new = np.ones(spans.shape[1], dtype=bool)
    new[1:] = (spans[:, 1:] != spans[:, :-1]).any(axis=0)
    starts, ends = spans[:, new]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _base_documents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The documents in which a base pattern can match: those with a long run of hex digits, an access prefix, or an assignment."""
    flagged = np.zeros(len(offsets) - 1, dtype=bool)
    hex_starts, hex_ends = K.runs(_HEX[data], offsets)
    flagged[np.searchsorted(offsets, hex_starts[hex_ends - hex_starts >= BASE["hex"][2]], "right") - 1] = True
    prefix = np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65)) if len(data) > 3 else []
    flagged[np.searchsorted(offsets, prefix, "right") - 1] = True
    signs = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    for d in np.unique(np.searchsorted(offsets, signs, "right") - 1).tolist():
        flagged[d] = flagged[d] or bool(_KEYWORD.search(data[offsets[d] : offsets[d + 1]].tobytes()))
    return np.flatnonzero(flagged)


def _base(data: np.ndarray, offsets: np.ndarray, tokens: tuple) -> tuple[dict[int, list], np.ndarray]:
    """The base spans of each document that has some, and which tokens lie apart from all of them."""
    of, starts, ends = tokens
    found, free = {}, np.ones(len(of), dtype=bool)
    for d in _base_documents(data, offsets).tolist():
        own = base_spans(_text(data, offsets, d))
        if own:
            found[d] = own
            before = np.r_[0, np.cumsum(K.starts_of_characters(data[offsets[d] : offsets[d + 1]]))]
            i, j = np.searchsorted(of, [d, d + 1]).tolist()
            a, b = before[starts[i:j] - offsets[d]], before[ends[i:j] - offsets[d]]
            spans = np.array(sorted((start, end) for start, end, _, _ in own))
            reach = np.r_[0, np.maximum.accumulate(spans[:, 1])]  # by number of spans that start before: how far they go
            free[i:j] = reach[np.searchsorted(spans[:, 0], b)] <= a
    return found, free


def _text(data: np.ndarray, offsets: np.ndarray, d: int) -> str:
    return data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")


class _Smallest:
    """The distinct tokens of smallest hash, at most about twice ``most`` at any time."""

    def __init__(self, most: int):
        self.most, self.held, self.bound = most, {}, 1 << 63

    def add(self, h: int, token: str) -> None:
        if h < self.bound:
            self.held[token] = h
            if len(self.held) >= 2 * self.most:
                self.held = {t: h for h, t in heapq.nsmallest(self.most, ((h, t) for t, h in self.held.items()))}
                self.bound = max(self.held.values())


def _hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big") >> 1


def learn(documents: DataFrame, text_col: str = "text", labelled: dict[str, list[str]] | None = None) -> Formats:
    """Learn the formats in one scan of all documents.

    Per kind the MOST_CREDENTIALS distinct base matches, and MOST_ORDINARY distinct ordinary tokens, of smallest
    hash are learnt from; a task keeps no more of them than that, and so does the driver.  ``labelled`` adds
    credentials that the caller has labelled, by kind.
    """
    schema = pa.schema([("kind", pa.string()), ("h", pa.int64()), ("token", pa.string())])
    bounds = [*((k, MOST_CREDENTIALS) for k in BASE), ("", MOST_ORDINARY)]

    def gather(batches):
        held = {kind: _Smallest(most) for kind, most in bounds}
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for _, _, block, own in K.blocks(data, offsets):
                tokens = _tokens(block, own)
                found, free = _base(block, own, tokens)
                for spans in found.values():
                    for _, _, kind, secret in spans:
                        held[kind].add(_hash(secret), secret)
                starts, ends = tokens[1][free], tokens[2][free]
                hashes = (K.span_hashes_any(block, starts, ends, K.EXACT) >> np.uint64(1)).astype(np.int64)
                for i in np.flatnonzero(hashes < held[""].bound).tolist():
                    held[""].add(int(hashes[i]), block[starts[i] : ends[i]].tobytes().decode())
        rows = [(kind, h, token) for kind, own in held.items() for token, h in own.held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([list(x) for x in zip(*rows)] or [[], [], []], schema)], schema=schema)

    scratch = Scratch(documents.sparkSession, "secrets")
    found = scratch.write(documents.select(F.col(text_col).alias("text")).mapInArrow(gather, "kind string, h bigint, token string").distinct(), "found")
    kept: dict[str, list[str]] = {kind: list(own) for kind, own in (labelled or {}).items()}
    for kind, most in bounds:
        own = found.where(F.col("kind") == kind).orderBy("h", "token").limit(most)
        kept.setdefault(kind, []).extend(r.token for r in own.collect())
    scratch.close()
    return Formats(kept, kept.pop(""))


def secret_scan(documents: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of each whole text: ``id_col, spans array<struct<kind,start,end,score>>`` by start, then kind.

    Offsets are code points, ends exclusive.  Base spans have score null; learnt ones have their ratio a symbol.
    Learnt spans overlap neither base spans nor each other: of overlapping candidates the one of highest ratio in
    all (ties: the first) is reported.  Null and empty texts have no spans; repeated rows each get theirs.
    """
    kind = dict(documents.dtypes)[id_col]
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("id", K.arrow_type(documents, id_col)), ("spans", pa.list_(struct))])
    held = documents.sparkSession.sparkContext.broadcast(formats)
    order = {k: i for i, k in enumerate([*BASE, LEARNT])}

    def work(data, offsets, batch):
        formats, tokens = held.value, _tokens(data, offsets)
        found, free = _base(data, offsets, tokens)
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for d, own in found.items():
            out[d] = [{"kind": k, "start": a, "end": b, "score": None} for a, b, k, _ in own]
        of, starts, ends = (x[free] for x in tokens)
        _, first, back = np.unique(K.span_hashes_any(data, starts, ends, K.EXACT), return_index=True, return_inverse=True)
        ratio = formats.scores(data, starts[first], ends[first])[back]
        good = np.flatnonzero((ratio >= LEAST_TOTAL) & (ratio >= LEAST_RATIO * (ends - starts)))
        taken = np.zeros(len(data), dtype=bool)
        characters = np.r_[0, np.cumsum(K.starts_of_characters(data))]
        for k in good[np.lexsort((starts[good], -ratio[good]))].tolist():
            d, i, j = int(of[k]), int(starts[k]), int(ends[k])
            if not taken[i:j].any():
                taken[i:j] = True
                start = int(characters[i] - characters[offsets[d]])
                out[d].append({"kind": LEARNT, "start": start, "end": start + j - i, "score": float(ratio[k]) / (j - i)})
        return ([sorted(own, key=lambda x: (x["start"], order[x["kind"]])) for own in out],)

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(K.map_texts(["id"], "text", work, schema), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id_col)

