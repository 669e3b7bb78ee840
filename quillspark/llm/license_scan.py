"""Licence scans: a generalised suffix automaton over the tokens of licence templates.

Texts stream through the automaton token by token, which gives at each place the longest run that also stands in some
template (its matching statistics). Known phrases are read off the states; maximal runs are chained along each template,
over words that are other or missing. A chain's share is what it covers over the longer of the template and its stretch of text.
Chains of a share that ``needed`` asks of the template's length are spans; of spans that overlap the one of the greatest share
stays, so of close templates the closest gives its label. All chains count, however many a text has. Rows are independent and
nothing is shuffled; the automaton is built once for each task from the templates, whose size is fixed.

Null and empty texts: no words, no places, no labels, score 0. Repeated rows are scanned each for itself; very long texts are
scanned whole; extra columns of any name take no part; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .common import id_and_bytes, map_texts

#: Words of the lower-cased text: runs of digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases whose every place counts, with their labels. Fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public licence texts and notices as their publishers word them, with their labels. Fixed values.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: A run counts from so many tokens on; a chain may skip so many tokens in text and template; a label needs this share of a
#: template of FEW tokens or more, and all tokens of shorter ones.
MIN_RUN, MAX_GAP, MIN_COVER, FEW = 2, 4, 0.75, 8


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A-Z alone


class SuffixAutomaton:
    """Of several token sequences. A state stands for the runs that end at the same places of the templates."""

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((k, at + 1))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # an earlier sequence has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new


class Scanner:
    """The automaton of phrases and templates, and what a text shows of them."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, min_run=MIN_RUN, max_gap=MAX_GAP, min_cover=MIN_COVER) -> None:
        sequences = [words_of(x.encode()) for x, _ in phrases] + [words_of(x.encode()) for _, x in templates]
        self.labels = [y for _, y in phrases] + [y for y, _ in templates]
        self.n_phrases, self.min_run, self.max_gap, self.min_cover = len(phrases), min_run, max_gap, min_cover
        self.ids = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.sizes = [len(s) for s in sequences]
        coded = [[self.ids[w] for w in s] for s in sequences]
        self.automaton = a = SuffixAutomaton(coded)
        shown: dict[int, list[int]] = defaultdict(list)  # phrases by the state where they end
        for k, tokens in enumerate(coded[: self.n_phrases]):
            s = 0
            for t in tokens:
                s = a.next[s][t]
            shown[s].append(k)
        self.shown: list[list[int]] = [[] for _ in a.length]  # phrases that are suffixes of a state's longest run
        for s in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            self.shown[s] = self.shown[a.link[s]] + shown[s]

    def statistics(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(start, phrase) of every place of a phrase; (end, length, state) of the runs that can't be extended."""
        a, get = self.automaton, self.ids.get
        nxt, link, length, shown, min_run = a.next, a.link, a.length, self.shown, self.min_run
        places, runs, state, run = [], [], 0, 0
        for at, token in enumerate(map(get, words)):
            if token is None:
                if run >= min_run:
                    runs.append((at, run, state))
                state = run = 0
                continue
            if token not in nxt[state]:
                if run >= min_run:
                    runs.append((at, run, state))
                while state > 0 and token not in nxt[state]:
                    state = link[state]
                run = length[state]
            if token in nxt[state]:
                state = nxt[state][token]
                run += 1
                if shown[state]:
                    places += [(at + 1 - self.sizes[k], k) for k in shown[state] if self.sizes[k] <= run]
        if run >= min_run:
            runs.append((len(words), run, state))
        return places, runs

    def needed(self, k: int) -> float:
        """The share of template ``k`` that gives its label."""
        return self.min_cover if self.sizes[k] >= FEW else 1.0

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[float, int, int, int, int]]:
        """(share, covered, start, end, template) of the best chain that ends with each run, at each place of each template."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        ends, link, length = self.automaton.ends, self.automaton.link, self.automaton.length
        for end, run, state in runs:
            # shorter ends of the run may stand in further places
            known, low = set(), end - run
            while state > 0 and run >= self.min_run:
                for place in ends[state] - known:
                    if place[0] >= self.n_phrases:
                        by_template[place[0]].append((end, place[1], run, low))
                known, state = ends[state], link[state]
                run = length[state]
        out = []
        for k, found in by_template.items():
            found.sort()
            open_: list[tuple[int, int, int, int]] = []  # chains: text end, template end, tokens covered, text start
            for end, at, run, low in found:
                covered, start = run, end - run
                open_ = [x for x in open_ if low - x[0] <= self.max_gap]  # longest runs start ever later
                for e, t, c, s in open_:
                    if end - run - e > self.max_gap:
                        continue
                    over = max(0, e - (end - run), t - (at - run))
                    if over < run and at > t and end > e and at - run - t <= self.max_gap and c + run - over > covered:
                        covered, start = c + run - over, s
                open_.append((end, at, covered, start))
                out.append((covered / max(self.sizes[k], end - start), covered, start, end, k))
        return out

    def scan_scored(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, str, float]], float]:
        """Number of words; (start, phrase) places; (first word, end, label, share) of the spans, which don't overlap; the greatest
        share of any chain."""
        words = words_of(text)
        places, runs = self.statistics(words)
        found = self.chains(runs)
        spans: list[tuple[int, int, str, float]] = []
        for share, _, start, end, k in sorted((x for x in found if x[0] >= self.needed(x[4])), key=lambda x: (-x[0], -x[1], x[2], self.labels[x[4]])):
            at = bisect_left(spans, (start, end))
            if (at == 0 or spans[at - 1][1] <= start) and (at == len(spans) or spans[at][0] >= end):
                spans.insert(at, (start, end, self.labels[k], share))
        return len(words), places, spans, max([x[0] for x in found], default=0.0)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, str, float]]]:
        return self.scan_scored(text)[:3]


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id; n_words; n_base, first_word, last_word: number, least and largest start of the phrases' places (null where
    there is none); base_labels: labels of the phrases found; labels: these and those of spans, both distinct, sorted,
    joined by commas; score: 1 with a phrase, else the largest share of a chain; spans: all that gave a label."""

    def make():
        scanner = Scanner(phrases, templates)

        def work(ids: list, texts: list[bytes]) -> dict:
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                n, places, sure, best = scanner.scan_scored(text)
                base = {scanner.labels[k] for _, k in places}
                starts = [s for s, _ in places]
                score = 1.0 if places else min(1.0, best)
                rows.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in sure})), score, [{"start": a, "end": b, "label": y, "cover": c} for a, b, y, c in sorted(sure)]))
            names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {x: [] for x in names}

        return work

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, cover: double>>"
    return map_texts(id_and_bytes(df, id_col, text_col), schema, make)
