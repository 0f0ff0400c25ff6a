"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template (and of the base phrases, which are
templates too). A text streams through it word by word: the state and the length kept at each
word are the matching statistics, the longest run that ends there and stands in a template.
Where such a run can grow no further and has at least LEAST words, it is an anchor in each
template that it comes from; anchors of a template that follow one another in the text and in
the template are chained to a span, and the share of the template that a chain covers is the
span's coverage. Templates are notices, which name a licence in a line, and whole licence
texts. Words that no template has reset the automaton, so only runs of template
words are walked.

Inputs: a null text is empty; an empty text has no words, labels or places, and score zero.
Texts are taken whole, a segment at a time. Rows that repeat, or have a null doc_id, get a
result each. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlode.llm.bpe import text_slices
from litlode.llm.common import map_batches
from litlode.llm.license_texts import NOTICES, TEXTS

# The base phrases, as asked for.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, text) of notices and of whole licences.
TEMPLATES = [*NOTICES, *TEXTS]
#: Words of the shortest anchor, least share of a template that makes a span, words that a chain may skip.
LEAST, COVERED, GAP = 3, 0.75, 12
NAMED = 0.5
SEGMENT = 1 << 20
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Automaton:
    """Generalised suffix automaton of token sequences, with the places of each state."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._add(last, token, places)
                places[last].add((number, at))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                places[self.link[s]] |= places[s]
        #: For each state the (sequence, position of the last token) of its runs.
        self.places = [sorted(p) for p in places]

    def _state(self, length: int, places: list[set[tuple[int, int]]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        places.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int, places: list[set[tuple[int, int]]]) -> int:
        """A copy of q for its runs of up to length[p] + 1 tokens."""
        copy = self._state(self.length[p] + 1, places)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _add(self, last: int, token: int, places: list[set[tuple[int, int]]]) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, token, places)
        new, p = self._state(self.length[last] + 1, places), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token, places)
        return new


class Scanner:
    """Matching statistics, base places and template spans of texts."""

    def __init__(self, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        sequences = [(label, t.encode().translate(_WORDS).decode().split()) for label, t in [*((label, t) for t, label in base.items()), *templates]]
        self.labels = [label for label, _ in sequences]
        self.sizes = [len(words) for _, words in sequences]
        self.n_base = len(base)
        self.ids = {w.encode(): k + 1 for k, w in enumerate(dict.fromkeys(w for _, words in sequences for w in words))}
        self.automaton = a = Automaton([[self.ids[w.encode()] for w in words] for _, words in sequences])
        #: For each state the base phrases that its longest run ends with.
        self.ends: list[list[int]] = [[n for n, at in p if n < self.n_base and at == self.sizes[n] - 1 and size == self.sizes[n]] for p, size in zip(a.places, a.length, strict=True)]
        for s in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            if a.link[s] > 0:
                self.ends[s] = sorted({*self.ends[s], *self.ends[a.link[s]]})

    def words(self, text: bytes) -> Iterator[list[bytes]]:
        at = 0
        while at < len(text):
            to = at + SEGMENT
            while to < len(text) and _WORDS[text[to]] != 32:
                to += 1
            yield text[at:to].translate(_WORDS).split()
            at = to

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """(number of words, base places (start, label), spans (start, end, label, coverage)), in words."""
        n, tokens, at = 0, [], []
        get = self.ids.get
        for words in self.words(text):
            ids = np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words))
            known = np.flatnonzero(ids)
            tokens += ids[known].tolist()
            at += (known + n).tolist()
            n += len(words)
        return n, *self._walk(tokens, at)

    def _walk(self, tokens: list[int], at: list[int]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        a, ends = self.automaton, self.ends
        step, link, length = a.next, a.link, a.length
        base: list[tuple[int, str]] = []
        anchors: list[tuple[int, int, int]] = []  # (last word, words, state)
        state = size = 0
        before = -2
        for token, place in zip(tokens, at, strict=True):
            if place != before + 1:
                if size >= LEAST:
                    anchors.append((before, size, state))
                state = size = 0
            before = place
            to = step[state].get(token)
            if to is None:
                if size >= LEAST:
                    anchors.append((place - 1, size, state))
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = step[state].get(token)
                if to is None:
                    continue
            state, size = to, size + 1
            if size > 1 and ends[state]:
                base += [(place - self.sizes[p] + 1, self.labels[p]) for p in ends[state] if size >= self.sizes[p]]
        if size >= LEAST:
            anchors.append((before, size, state))
        return base, self._chain(anchors)

    def _chain(self, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Anchors in text order, chained template by template."""
        open_: dict[int, list[int]] = {}  # template: [start, end in the text, end in the template, words covered]
        spans: list[tuple[int, int, str, float]] = []

        def close(t: int) -> None:
            start, end, _, covered = open_.pop(t)
            if covered >= COVERED * self.sizes[t]:
                spans.append((start, end, self.labels[t], covered / self.sizes[t]))

        for last, size, state in anchors:
            for t, place in self.automaton.places[state]:
                if t < self.n_base:
                    continue
                start, first = last - size + 1, place - size + 1
                if t in open_:
                    chain = open_[t]
                    cut = max(0, chain[1] - start, chain[2] - first)  # words of the anchor that the chain has already
                    if cut < size and start + cut - chain[1] <= GAP and chain[2] <= first + cut and place + 1 > chain[2]:
                        chain[1], chain[2], chain[3] = last + 1, place + 1, chain[3] + size - cut
                        continue
                    if start < chain[1]:
                        continue
                    close(t)
                open_[t] = [start, last + 1, place + 1, size]
        for t in list(open_):
            close(t)
        return sorted(spans)


_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, spans) of every row.

    places: array of (start, label) of base phrases; spans: array of (start, end, label, coverage) of templates, in words.
    """
    places = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for b in batches:
            for at, to, data, offsets in text_slices(b, 1):
                ends = offsets.tolist()
                found = [scan(data[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
                columns = [
                    b.column(0).slice(at, to - at),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": s, "label": x} for s, x in p] for _, p, _ in found], places),
                    pa.array([[{"start": s, "end": e, "label": x, "coverage": c} for s, e, x, c in p] for _, _, p in found], spans),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "places", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, places array<struct<start: long, label: string>>, spans array<struct<start: long, end: long, label: string, coverage: double>>"
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def license_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the greatest coverage of a span, NAMED if a licence is named but no template is covered, else 0.
    """
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan_licenses(df).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"),
        F.coalesce(F.array_max("spans.coverage"), F.when(F.size("places") > 0, NAMED).otherwise(0.0)).alias("score"),
    )
