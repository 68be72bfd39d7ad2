"""License scans with a generalised suffix automaton (operator 3).

The automaton holds all runs of words of the license templates and of the base phrases. A
text streams through it once and yields matching statistics: at each word, the longest run
ending there that some template has. Base places are the words at which the run that
matches ends with a base phrase. Long maximal runs are chained, in ascending order on both
sides with bounded gaps, into covered spans of a template; the share of the template that a
chain covers is its score. A template counts as found from a share of ``cover``.

Nulls: a null text has no words. Texts without license words have no labels and score 0.
Equal texts get equal rows. Very long texts are scanned whole; what is kept of one is its
runs of template words. Of chains with equal cover the first one counts. An empty table
gives an empty result. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import wordkit

#: Phrases and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license texts and notices, and the labels they give.
TEMPLATES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see""",
    ),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "distributed under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc", "this work is licensed under a creative commons attribution"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited"),
)


@dataclass(frozen=True)
class Match:
    """A run of ``n`` words that starts at ``at`` in the text and at ``place`` in a template."""

    at: int
    place: int
    n: int


class Automaton:
    """Generalised suffix automaton of word-number sequences, with the ends of each state's runs."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((t, i + 1))
        longest_first = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for state in longest_first:
            self.ends[self.link[state]] |= self.ends[state]
        #: Of each state the nearest of itself and its suffixes that is marked, see ``mark``.
        self.marked: list[int] = [0] * len(self.next)
        self.marks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self._shortest_first = longest_first[::-1]

    def mark(self, phrases: list[list[int]]) -> None:
        """Makes the phrases, which templates must have, known to ``endings``."""
        for number, phrase in enumerate(phrases):
            *_, (state, length) = self.statistics(phrase)
            if length != len(phrase):
                raise ValueError("a phrase is in no template")
            self.marks[state].append((length, number))
        for state in self._shortest_first:
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]]

    def endings(self, state: int, length: int) -> Iterator[int]:
        """Numbers of the marked phrases that the run of ``length`` words in ``state`` ends with."""
        while state := self.marked[state]:
            yield from (number for n, number in self.marks[state] if n <= length)
            state = self.link[state]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after), self.link.append(link), self.length.append(length), self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the runs of ``q`` that are one word longer than ``p`` at most."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """At each word the state and the length of the longest run that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            yield state, length

    def scan(self, words: list[int], least: int, offset: int = 0) -> tuple[dict[int, list[Match]], list[tuple[int, int]]]:
        """Maximal runs of ``least`` words or more, by template, and (last word, number) of marked phrases."""
        out: dict[int, list[Match]] = defaultdict(list)
        phrases: list[tuple[int, int]] = []
        before = (0, 0)
        for i, (state, length) in enumerate([*self.statistics(words), (0, 0)]):
            if before[1] >= least and length <= before[1]:
                for t, end in self.ends[before[0]]:
                    out[t].append(Match(offset + i - before[1], end - before[1], before[1]))
            if self.marked[state]:
                phrases += ((offset + i, number) for number in self.endings(state, length))
            before = (state, length)
        return out, phrases


def chain(found: list[Match], gap: int) -> tuple[int, int, int]:
    """(most template words that runs cover which ascend on both sides with bounded gaps, from, to).

    A sweep by the runs' starts: what ended more than ``gap`` words ago can have no successor
    and is left behind, so a run is held against the few runs that are near it in the text.
    """
    near: list[tuple[Match, int, int]] = []  # run, most words up to its end, where its chain starts
    best = (0, 0, 0)
    for m in sorted(set(found), key=lambda m: (m.at, m.place)):
        near = [x for x in near if m.at - x[0].at - x[0].n <= gap]
        top, start = m.n, m.at
        for p, words, since in near:
            lap = max(0, p.at + p.n - m.at, p.place + p.n - m.place)
            if p.at < m.at and p.place < m.place and lap < m.n and m.place - p.place - p.n <= gap and words + m.n - lap > top:
                top, start = words + m.n - lap, since
        near.append((m, top, start))
        if top > best[0]:
            best = (top, start, m.at + m.n)
    return best


class Scanner:
    """Templates and phrases as numbers, ready for texts."""

    def __init__(self, templates=TEMPLATES, phrases=None, least: int = 4, gap: int = 6, cover: float = 0.6) -> None:
        phrases = PHRASES if phrases is None else phrases
        self.least, self.gap, self.cover = least, gap, cover
        self.labels = [label for label, _ in templates]
        self.phrases = list(phrases.values())
        hashed = [wordkit.words(text.encode(), wordkit.ALNUM) for text in (*(text for _, text in templates), *phrases)]
        self.sizes = [len(h) for h in hashed]
        self.vocabulary = np.unique(np.concatenate(hashed))
        numbers = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.automaton = Automaton(numbers)
        self.automaton.mark(numbers[len(templates) :])

    def scan(self, text: bytes | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score and spans of a text."""
        h = wordkit.words(text, wordkit.ALNUM)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.concatenate([[False], self.vocabulary[at] == h, [False]]) if len(h) else np.zeros(2, dtype=bool)
        lo, hi = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
        found: dict[int, list[Match]] = defaultdict(list)
        base: list[tuple[int, int]] = []
        least = min([self.least, *self.sizes[len(self.labels) :]])
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if b - a >= least:  # no run of template words is longer than a stretch of known words
                runs, phrases = self.automaton.scan(at[a:b].tolist(), self.least, a)
                base += phrases
                for t, some in runs.items():
                    if t < len(self.labels):
                        found[t] += some
        chains = {t: chain(runs, self.gap) for t, runs in found.items()}
        shares = {t: c[0] / self.sizes[t] for t, c in chains.items()}
        spans = [{"template": t, "label": self.labels[t], "lo": chains[t][1], "hi": chains[t][2], "share": share} for t, share in sorted(shares.items()) if share >= self.cover]
        base_labels = sorted({self.phrases[number] for _, number in base})
        places = [i + 1 - self.sizes[len(self.labels) + number] for i, number in base]
        score = min(1.0, max([*shares.values(), 0.5 if base else 0.0]))
        return len(h), len(places), min(places, default=None), max(places, default=None), ",".join(base_labels), ",".join(sorted({*base_labels, *(s["label"] for s in spans)})), score, spans


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with its license words, labels, score and the covered spans of templates (in words)."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    span = pa.struct([("template", pa.int32()), ("label", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("share", pa.float64())])
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.scan(x.as_py()) for x in batch.column(1).cast(pa.large_binary())]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], names=["doc_id", *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:int,label:string,lo:long,hi:long,share:double>>")
