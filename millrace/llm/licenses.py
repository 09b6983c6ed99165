"""License scan: matching statistics against suffix automata of license tokens.

A template's automaton accepts every run of its tokens. A text is streamed
through it; at each token it gives the length of the longest run ending there
that the template holds. Runs that can't be extended and have MIN_MATCH tokens or more
are looked up in the template, and the matches that advance in
both text and template are chained to cover as many template tokens as
possible. Chains over MIN_COVERAGE of a template are reported. Each template has an
automaton of its own, so that a notice which a full text holds too is found whatever follows it.

A text is streamed only for the templates it may cover: those of which the runs of MIN_MATCH
tokens that the text holds, wherever they are, make up MIN_COVERAGE. These runs are found for a
whole batch with array operations. Tokens outside a template reset its automaton, so only
stretches of MIN_MATCH or more known tokens are streamed. Nothing is skipped by either.

Templates are single-line notices, SPDX tags, and the files of license_texts: full texts and standard file
headers, NAME.txt or NAME.part.txt.

Defined results: a null or empty text has no span; templates with fewer than MIN_MATCH
tokens match nothing; of equal templates each is reported; a text that holds a
notice several times has a span for each; where spans overlap, the one that covers most
tokens holds (ties: the larger share, then the name). Repeated rows are reported each. In a text whose
characters combine otherwise as a whole than one by one, a span is the whole text. Other columns
are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import lean, texts_of
from .decontamination import word_spans
from .textvec import gram_hashes, normalise, slices, word_hashes

MIN_MATCH, MIN_COVERAGE, MAX_GAP = 3, 0.8, 8
_WORD = re.compile(r"[^\W_]+")
#: Most template tokens whose automaton is sent to the workers.
MAX_TOKENS = 2_000_000

#: (license, notice): single lines by which works name their license.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU GPL v3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the 3-clause BSD license."),
    ("BSD-2-Clause", "Released under the 2-clause BSD license."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
)
#: Identifiers that files carry in a tag; a tag names its license whole, so each is a notice.
TAGS: tuple[tuple[str, str], ...] = tuple(
    (re.sub(r"-(only|or-later)$", "", i), f"SPDX-License-Identifier: {i}")
    for i in "MIT ISC Unlicense Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-1.1 MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
)
#: (license, text): full texts and standard file headers.
TEXTS: tuple[tuple[str, str], ...] = tuple((re.split(r"\.[a-z]", p.name)[0], p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
TEMPLATES = NOTICES + TAGS + TEXTS
SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("template", T.IntegerType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("covered", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)


@dataclass
class SuffixAutomaton:
    """Of several token sequences at once; state 0 is the root."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Ends of templates' prefixes, for the states made by them: (template, tokens up to here).
    own: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def add(self, tokens: list[int], template: int) -> None:
        last = 0
        for place, token in enumerate(tokens):
            last = self._extend(last, token)
            self.own[last].append((template, place + 1))

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.next) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # another template has been here
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
        return new

    def finish(self) -> None:
        """Lays the states out so that the ends below a state in the link tree are one slice."""
        children: list[list[int]] = [[] for _ in self.link]
        for state, up in enumerate(self.link):
            if up >= 0:
                children[up].append(state)
        self.ends: list[tuple[int, int]] = []
        self.first, self.after = [0] * len(self.link), [0] * len(self.link)
        stack = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                self.after[state] = len(self.ends)
                continue
            self.first[state] = len(self.ends)
            self.ends += self.own[state]
            stack.append((state, True))
            stack += [(c, False) for c in children[state]]

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(longest match ending here, its state) for each token; -1 is a token of no template."""
        out, state, length = [], 0, 0
        follow, link, lengths = self.next, self.link, self.length
        for token in tokens:
            while state and token not in follow[state]:
                state = link[state]
                length = lengths[state]
            q = follow[state].get(token)
            if q is None:
                state = length = 0
            else:
                state, length = q, length + 1
            out.append((length, state))
        return out

    def places(self, state: int) -> list[tuple[int, int]]:
        """(template, end) of every occurrence of a state's runs."""
        return self.ends[self.first[state] : self.after[state]]


class Scanner:
    def __init__(self, templates, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP):
        self.templates = list(templates)
        self.min_match, self.min_coverage, self.max_gap = min_match, min_coverage, max_gap
        words, at = word_hashes([t for _, t in self.templates])
        self.vocabulary = np.unique(words)
        ids = np.searchsorted(self.vocabulary, words)
        self.sizes = np.diff(at).tolist()
        self.ids = [ids[a:b] for a, b in zip(at, at[1:])]
        self.automata: dict[int, SuffixAutomaton] = {}
        # the runs of min_match tokens of all templates: their hashes, and at which token of which template each begins
        self.run = max(1, min_match)
        runs = [self._runs(words[a:b]) for a, b in zip(at, at[1:])]
        self.run_hashes, self.run_of = np.unique(np.concatenate([np.zeros(0, np.uint64), *runs]), return_inverse=True)
        self.run_at = np.concatenate([np.zeros(0, np.int64), *[a + np.arange(len(r)) for a, r in zip(at, runs)]])
        self.at = at
        self.need = np.array([min_coverage * n for n in self.sizes])
        self.least = min((-(-c // self.run) for c, n in zip(self.need, self.sizes) if n >= self.run), default=np.inf)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _runs(self, words: np.ndarray) -> np.ndarray:
        return gram_hashes(words, range(self.run))

    def automaton(self, template: int) -> SuffixAutomaton:
        if template not in self.automata:
            made = self.automata[template] = SuffixAutomaton()
            made.add(self.ids[template].tolist(), template)
            made.finish()
        return self.automata[template]

    def candidates(self, runs: np.ndarray) -> list[int]:
        """Templates of which runs (places in run_hashes, those of a text) make up min_coverage."""
        held = np.zeros(len(self.run_hashes), bool)
        held[runs] = True
        begins = self.run_at[held[self.run_of]]
        covered = np.zeros(self.at[-1] + 1, bool)
        for k in range(self.run):
            covered[begins + k] = True
        sums = np.concatenate(([0], np.cumsum(covered)))
        share = sums[self.at[1:]] - sums[self.at[:-1]]
        return np.flatnonzero((share >= self.need) & (share > 0)).tolist()

    def token_ids(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.quick[(words & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, words[maybe])
        place[place == len(self.vocabulary)] = 0
        same = self.vocabulary[place] == words[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        out[maybe[same]] = place[same]
        return out

    def matches(self, ids: list[int], offset: int, template: int) -> list[tuple[int, int, int, int]]:
        """(template, start in text, start in template, length) of the runs that can't be extended."""
        automaton = self.automaton(template)
        found, stats = [], automaton.statistics(ids)
        for i, (length, state) in enumerate(stats):
            if length >= self.min_match and (i + 1 == len(stats) or stats[i + 1][0] <= length):
                found += [(t, offset + i + 1 - length, end - length, length) for t, end in automaton.places(state)]
        return found

    def chains(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, start in text, end in text, covered tokens) of the chains over min_coverage, overlaps resolved."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, a, p, n in found:
            by_template.setdefault(t, []).append((a, p, n))
        spans = []
        for t, runs in by_template.items():
            runs.sort()
            best: list[tuple[int, int]] = []  # covered tokens, run before
            near: list[int] = []  # runs that end no more than max_gap before
            for i, (a, p, n) in enumerate(runs):
                top = (n, -1)
                near = [j for j in near if a - (runs[j][0] + runs[j][2]) <= self.max_gap]
                for j in reversed(near):
                    b, q, m = runs[j]
                    # the later run counts what it adds in both text and template
                    overlap = max(0, b + m - a, q + m - p)
                    if b < a and q < p and overlap < n and best[j][0] + n - overlap > top[0]:
                        top = (best[j][0] + n - overlap, j)
                best.append(top)
                near.append(i)
            used: set[int] = set()
            for i in sorted(range(len(runs)), key=lambda i: (-best[i][0], runs[i])):
                chain, k = [], i
                while k >= 0 and k not in used:
                    chain.append(k)
                    k = best[k][1]
                if k >= 0:  # it shares runs with a better chain
                    continue
                used.update(chain)
                covered = best[i][0]
                if covered >= self.min_coverage * self.sizes[t]:
                    spans.append((t, runs[chain[-1]][0], runs[i][0] + runs[i][2], covered))
        kept: list[tuple[int, int, int, int]] = []
        for s in sorted(spans, key=lambda s: (-s[3], -s[3] / self.sizes[s[0]], self.templates[s[0]][0], s)):
            if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
                kept.append(s)
        return sorted(kept, key=lambda s: s[1])

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, str, int, int, int, int, float]]:
        """(text, license, template, start_char, end_char, covered, coverage) of all texts."""
        words, at = word_hashes(texts)
        ids = self.token_ids(words)
        if not len(self.run_hashes) or not len(words):
            return
        # runs of templates within one text
        known = ids >= 0
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        n = len(ids) - self.run + 1
        inside = known[:n].copy() if n > 0 else np.zeros(0, bool)
        for k in range(1, self.run):
            inside &= known[k : n + k]
        begins = np.flatnonzero(inside)
        begins = begins[row[begins] == row[begins + self.run - 1]]
        hashes = np.zeros(len(begins), np.uint64)
        if len(begins):
            hashes = self._runs(words)[begins]
        place = np.searchsorted(self.run_hashes, hashes)
        place[place == len(self.run_hashes)] = 0
        same = self.run_hashes[place] == hashes
        held, of = place[same], row[begins[same]]
        # stretches of known tokens within one text
        new = np.concatenate(([True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])))[: len(ids)]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(ids)))
        long = known[starts] & (sizes >= self.min_match)
        starts, sizes = starts[long], sizes[long]
        of_row = row[starts]
        by_text: dict[int, list] = {}
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(of))):
            if b - a < self.least:
                continue
            i = int(of[a])
            some = slice(*np.searchsorted(of_row, (i, i + 1)))
            for t in self.candidates(held[a:b]):
                for first, size in zip(starts[some].tolist(), sizes[some].tolist()):
                    found = self.matches(ids[first : first + size].tolist(), first - int(at[i]), t)
                    if found:
                        by_text.setdefault(i, []).extend(found)
        for i, found in by_text.items():
            spans = self.chains(found)
            if spans:
                chars = word_spans(texts[i], _WORD)[1]
                if len(chars) != len(normalise(texts[i]).split()):  # marks that combine across characters: no word has its place
                    chars = [(0, len(texts[i]))] * len(normalise(texts[i]).split())
                for t, a, b, covered in spans:
                    yield i, self.templates[t][0], t, chars[a][0], chars[b - 1][1], covered, covered / self.sizes[t]


_SCANNERS: dict = {}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP) -> DataFrame:
    """doc_id, license, template, start_char, end_char, covered, coverage: every covered template span of every text."""
    templates = [(name, text) for name, text in templates if text]
    if (size := sum(len(normalise(t).split()) for _, t in templates)) > MAX_TOKENS:
        raise ValueError(f"{size} template tokens are too many for one automaton; scan in several calls")
    settings = (tuple(templates), min_match, min_coverage, max_gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _SCANNERS.get("key") != settings:
            _SCANNERS.update(key=settings, scanner=Scanner(*settings))
        scanner = _SCANNERS["scanner"]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            for first, last in slices(texts):
                rows = [(ids[first + i], *rest) for i, *rest in scanner.scan(texts[first:last])]
                if rows:
                    yield from pa.Table.from_pylist([dict(zip(SPANS.names, r)) for r in rows], pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("covered", pa.int32()), ("coverage", pa.float64())])).to_batches()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lean(run), SPANS)
