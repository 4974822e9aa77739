"""Secrets in whole texts: fixed formats, and formats learned by grammar inference.

Matches of the fixed formats are labelled credentials. From a bounded sample of them
a prefix tree is built for each kind, and states that are statistically compatible
(Hoeffding's bound on the frequencies of stopping and of each next symbol, here and
in all that follows) are merged into a probabilistic automaton. Every other token of
a text, and every part of it between cut symbols, that is as long as the shortest
labelled value is scored by its likelihood per symbol under each automaton, against
that under the symbols' plain frequencies; those that fit a format as well as the
labelled ones do are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ship, stored, whole_text

#: The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: A key may also begin or end beside these symbols of a candidate.
CUT = re.compile(r"[=/.]")
#: Words one of which every match of ASSIGN has, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Bounds of the sample that automata are fitted on: values a kind, and symbols a value.
SAMPLE_VALUES, SAMPLE_LENGTH = 400, 128
ALPHA = 1e-3
SLACK = 1.1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed formats, leftmost and non-overlapping by
    kind. Runs of hex digits and of access-key characters are maximal, so asking for
    the least length at once finds the same matches as dropping short ones."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]], least: int = 1) -> list[tuple[int, int, str]]:
    """Tokens that could be keys, of `least` symbols or more: what base spans leave of each."""
    out, k = [], 0
    covered: list[list[int]] = []
    for s, _, e, _ in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a < least:
            continue
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        at = k
        while at < len(covered) and covered[at][0] < b:
            if covered[at][0] - a >= least:
                out.append((a, covered[at][0], text[a : covered[at][0]]))
            a = max(a, covered[at][1])
            at += 1
        if b - a >= least:
            out.append((a, b, text[a:b]))
    return out


class Automaton:
    """A frequency prefix tree and, after fit(), the automaton that its merging leaves."""

    def __init__(self):
        self.stops: list[int] = [0]
        self.cuts: list[int] = [0]  # values of which only the symbols so far are known
        self.tail: dict[str, int] = {}  # symbols of such values
        self._known: dict[int, tuple[dict[str, tuple[int, float]], float, int]] = {}
        self.next: list[dict[str, list[int]]] = [{}]  # symbol -> [state, times]

    def add(self, value: str) -> None:
        """Counts a value, of a longer one its first SAMPLE_LENGTH symbols and no end."""
        state, whole = 0, len(value) <= SAMPLE_LENGTH
        value = value[:SAMPLE_LENGTH]
        for c in value:
            edge = self.next[state].get(c)
            if edge is None:
                self.stops.append(0)
                self.cuts.append(0)
                self.next.append({})
                edge = self.next[state][c] = [len(self.stops) - 1, 0]
            edge[1] += 1
            state = edge[0]
        if whole:
            self.stops[state] += 1
            return
        self.cuts[state] += 1
        for c in value:
            self.tail[c] = self.tail.get(c, 0) + 1

    def visits(self, state: int) -> int:
        return self.stops[state] + sum(n for _, n in self.next[state].values())

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            na, nb = self.visits(a), self.visits(b)
            if not na or not nb:
                continue
            limit = bound * (1 / sqrt(na) + 1 / sqrt(nb))
            if abs(self.stops[a] / na - self.stops[b] / nb) >= limit:
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                (ta, ka), (tb, kb) = self.next[a].get(c, (-1, 0)), self.next[b].get(c, (-1, 0))
                if abs(ka / na - kb / nb) >= limit:
                    return False
                if ta >= 0 and tb >= 0:
                    todo.append((ta, tb))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stops[a] += self.stops[b]
            self.cuts[a] += self.cuts[b]
            for c, (t, n) in self.next[b].items():
                if (edge := self.next[a].get(c)) is None:
                    self.next[a][c] = [t, n]
                else:
                    edge[1] += n
                    if edge[0] != t:
                        todo.append((edge[0], t))

    def fit(self, alpha: float = ALPHA) -> Automaton:
        """Merges from the root outwards. A state is merged into the first compatible one
        of its own depth, so that what a format says by position and length stays;
        without one it is kept."""
        bound = sqrt(0.5 * log(2 / alpha))
        layer = [0]
        while layer:
            kept: list[int] = []
            for parent in layer:
                for c, edge in sorted(self.next[parent].items()):
                    if edge[0] in kept:
                        continue
                    same = next((k for k in kept if self._compatible(k, edge[0], bound)), None)
                    if same is None:
                        kept.append(edge[0])
                    else:
                        old, edge[0] = edge[0], same
                        self._fold(same, old)
            layer = kept
        self._known.clear()
        return self

    def _costs(self, state: int, unseen: float) -> tuple[dict[str, tuple[int, float]], float, int]:
        """Of a state (-1: after the sampled part of a longer value): the next state and the
        log-likelihood of each symbol, that of an end, and where other symbols lead."""
        if state < 0:
            total = sum(self.tail.values())
            return {c: (-1, log(n / total)) for c, n in self.tail.items()}, log(unseen), -1
        n = self.visits(state) + self.cuts[state]
        edges = {c: (t, log(k / n)) for c, (t, k) in self.next[state].items()}
        if self.cuts[state]:
            edges = {c: (-1, v + log(self.cuts[state] / n)) for c, (_, v) in self._costs(-1, unseen)[0].items()} | edges
        after = max(self.next[state].values(), key=lambda e: e[1], default=[-1 if self.cuts[state] else state])[0]
        return edges, log(max(self.stops[state] / n, unseen)) if n else log(unseen), after

    def score(self, value: str, unseen: float = 1e-3, end: bool = True) -> float:
        """Log-likelihood a symbol of the whole value; a symbol or an end that a state never
        saw costs `unseen`, and the commonest edge is taken. Without `end` the value
        is one that was cut."""
        state, total = 0, 0.0
        for c in value:
            if (known := self._known.get(state)) is None:
                known = self._known[state] = self._costs(state, unseen)
            state, cost = known[0].get(c) or (known[2], log(unseen))
            total += cost
        if not end:
            return total / max(len(value), 1)
        return (total + self._costs(state, unseen)[1]) / (len(value) + 1)

    def scores(self, value: str, start: int, places: set[int], least: float, unseen: float = 1e-3) -> Iterator[tuple[int, float]]:
        """(end, score) of the parts of a value from start to each place, in one pass. It ends
        where nothing is known any more and longer parts only fall further below least."""
        state, total = 0, 0.0
        for at in range(start, len(value)):
            if (known := self._known.get(state)) is None:
                known = self._known[state] = self._costs(state, unseen)
            if not known[0] and not self.tail and log(unseen) < least and total < least * (at - start + 1):
                return
            state, cost = known[0].get(value[at]) or (known[2], log(unseen))
            total += cost
            if at + 1 in places:
                if state not in self._known:
                    self._known[state] = self._costs(state, unseen)
                yield at + 1, (total + self._known[state][1]) / (at + 2 - start)

    def usual(self) -> float:
        """Mean log-likelihood of a symbol after the sampled part."""
        total = sum(self.tail.values())
        return sum(n * log(n / total) for n in self.tail.values()) / total


def learned(values: list[str]) -> Automaton:
    a = Automaton()
    for v in values:
        a.add(v)
    return a.fit()


class Formats:
    """Automata of all kinds, the least score that counts, and the plain frequencies. The
    least score is what all but a twentieth of labelled values reach under an automaton
    fitted on the other half of them, with some slack; symbols after the sampled part are
    held against their own mean, as values say nothing of them."""

    def __init__(self, labelled: dict[str, list[str]], shortest: dict[str, int] | None = None):
        """shortest: lengths of all labelled values' shortest, where labelled is a sample."""
        self.automata: dict[str, tuple[Automaton, float]] = {}
        self.shortest: dict[str, int] = {}
        counts: dict[str, int] = {}
        for kind, values in labelled.items():
            if len(values) < 8:
                continue
            self.shortest[kind] = (shortest or {}).get(kind) or min(map(len, values))
            half = learned(values[::2])
            scores = sorted(half.score(v[:SAMPLE_LENGTH], end=len(v) <= SAMPLE_LENGTH) for v in values[1::2])
            self.automata[kind] = (learned(values), scores[ceil(len(scores) * 0.05) - 1] * SLACK)
            for v in values:
                for c in v[:SAMPLE_LENGTH]:
                    counts[c] = counts.get(c, 0) + 1
        total = sum(counts.values())
        self.plain = {c: log(n / total) for c, n in counts.items()}
        self.rare = log(1 / (total + 68)) if total else 0.0

    @staticmethod
    def _least(a: Automaton, least: float, n: int) -> float:
        if n <= SAMPLE_LENGTH or not a.tail:
            return least
        return (least * (SAMPLE_LENGTH + 1) + a.usual() * SLACK * (n - SAMPLE_LENGTH)) / (n + 1)

    def best(self, value: str) -> str | None:
        """The kind whose format the value fits best, if it fits one."""
        plain = sum(self.plain.get(c, self.rare) for c in value) / (len(value) + 1)
        found = [(s, kind) for kind, (a, least) in self.automata.items() if (s := a.score(value)) >= self._least(a, least, len(value)) and s > plain]
        return max(found)[1] if found else None

    def least_length(self) -> int | None:
        """Symbols of the shortest token to score; None: there is no format."""
        return min(self.shortest.values(), default=None)

    def parts(self, token: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of what fits a format in a token, cut anywhere beside =, / and
        dots: from left to right the longest, of the kind that it fits best."""
        places = {0, len(token)}
        for m in CUT.finditer(token):
            places |= {m.start(), m.end()}
        sums = [0.0]
        for c in token:
            sums.append(sums[-1] + self.plain.get(c, self.rare))
        out: list[tuple[int, int, str]] = []
        for a in sorted(places):
            if out and a < out[-1][1]:
                continue
            found = []
            for kind, (automaton, least) in self.automata.items():
                if len(token) - a < self.shortest[kind]:
                    continue
                for b, s in automaton.scores(token, a, places, least):
                    n = b - a
                    if n >= self.shortest[kind] and s >= self._least(automaton, least, n) and s > (sums[b] - sums[a]) / (n + 1):
                        found.append((b, s, kind))
            if found:
                b, _, kind = max(found)
                out.append((a, b, kind))
        return out


def labelled_values(docs: DataFrame) -> DataFrame:
    """kind, value, length of every fixed-format span of the whole texts (null: empty);
    one symbol over SAMPLE_LENGTH tells that a value goes on."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, v[: SAMPLE_LENGTH + 1], len(v)) for text in batch.column(0).to_pylist() for _, k, _, v in base_spans(text)]
            cols = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32()))], ["kind", "value", "length"])

    return docs.select(whole_text().alias("text")).mapInArrow(run, "kind int, value string, length int")


def fit_formats(values: DataFrame, sample: int = SAMPLE_VALUES) -> Formats:
    """Automata from at most `sample` distinct values a kind: those with the smallest
    hashes, whatever the partitions. Beside them only the shortest lengths reach the driver."""
    labelled = {}
    for k, kind in enumerate(KINDS):
        of_kind = values.filter(F.col("kind") == k).select("value", F.xxhash64("value").alias("h")).distinct()
        labelled[kind] = [r.value for r in of_kind.orderBy("h", "value").limit(sample).collect()]
    shortest = {KINDS[r.kind]: r.n for r in values.groupBy("kind").agg(F.min("length").alias("n")).collect()}
    return Formats(labelled, shortest)


def scan_secrets(docs: DataFrame, sample: int = SAMPLE_VALUES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every row.

    The text is read twice: labelled values are stored and automata fitted on them, then
    the tokens are scored where they stand. spans lists all spans as kind:start:end by
    start, then kind; added ones are called like_<kind>. Null and empty texts have
    none; repeated rows give repeated rows; with under 8 labelled values of a kind it
    adds nothing."""
    formats = fit_formats(stored(labelled_values(docs), "secret-values"), sample)
    least = formats.least_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lru_cache(1 << 16)(formats.parts)
        for batch in batches:
            out = []
            for doc_id, body in zip(*(c.to_pylist() for c in batch.columns)):
                base = base_spans(body)
                own = [(s, k, e, KINDS[k]) for s, k, e, _ in base]
                added = []
                for at, _, token in candidates(body, base, least) if least else ():
                    for s, e, kind in (short if len(token) <= SAMPLE_LENGTH else formats.parts)(token):
                        added.append((at + s, len(KINDS) + KINDS.index(kind), at + e, f"like_{kind}"))
                text = lambda spans: ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(spans))
                n = [sum(k == j for _, j, _, _ in base) for k in range(len(KINDS))]
                out.append((doc_id, *n, hashlib.sha256(text(own).encode()).hexdigest(), text(own + added), len(added)))
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
