"""License scans by a generalised suffix automaton over the words of licence templates.

A text's words are streamed through the automaton, which gives the matching statistics: for every word the longest stretch, ending there, that occurs
in some template, and where. Long matches that run in a template's order are chained; a template that its chain covers well is reported. Phrases are
templates of their own, and every place where one stands is counted.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import per_row, table, texts

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Opening or characteristic parts of public licences, and their labels.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
        deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
        but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details.""",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
    "cc-by-sa": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: A match counts from so many words; links of a chain may skip so many words on either side; a template is reported from this share of it, in words.
LONG, SKIP, COVERED = 4, 12, 0.6

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Runs of a-z (A-Z lower-cased), digits and everything beyond ASCII, as UTF-8."""
    return text.encode().translate(_WORDS).split()


class Automaton:
    """States of a generalised suffix automaton: step[s] (word -> state), link[s], size[s] (its longest string), end[s] (template, position) where it first ends."""

    def __init__(self, sequences: list[list[bytes]]):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [(-1, -1)]
        for t, sequence in enumerate(sequences):
            last = 0
            for position, word in enumerate(sequence):
                last = self._extend(last, word, (t, position))

    def _state(self, size: int, step: dict, link: int, end: tuple[int, int]) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.end.append(end)
        return len(self.step) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q], self.end[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes, end: tuple[int, int]) -> int:
        q = self.step[last].get(word)
        if q is not None:  # another template began so
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.size[last] + 1, {}, 0, end), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def run(self, sequence: list[bytes]):
        """Matching statistics: (state, length) after each word."""
        step, link, size, state, n = self.step, self.link, self.size, 0, 0
        for word in sequence:
            while state and word not in step[state]:
                state = link[state]
                n = size[state]
            if word in step[state]:
                state, n = step[state][word], n + 1
            yield state, n


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.labels = [*phrases.values(), *templates]
        self.sequences = [words(t) for t in [*phrases, *templates.values()]]
        self.n_phrases = len(phrases)
        self.automaton = a = Automaton(self.sequences)
        #: Templates that hold what a state stands for, and where it ends in them.
        self.places: list[list[tuple[int, int]]] = [[] for _ in a.step]
        own: dict[int, list[int]] = defaultdict(list)
        for t, sequence in enumerate(self.sequences):
            state = 0
            for position, (state, _) in enumerate(a.run(sequence)):
                up = state
                while up > 0:
                    self.places[up].append((t, position))
                    up = a.link[up]
            if t < self.n_phrases:
                own[state].append(t)
        #: Phrases that end where a state ends.
        self.ending: list[list[int]] = [[] for _ in a.step]
        for state in range(1, len(a.step)):
            up = state
            while up > 0:
                self.ending[state] += own.get(up, [])
                up = a.link[up]
        self.known = frozenset(w for s in self.sequences for w in s)
        self.shortest = min((len(s) for s in self.sequences), default=1)

    def scan(self, text: str) -> tuple:
        """Words of the text, places of phrases (start, phrase), and per label the share of its best template that a chain covers."""
        text_words, known = words(text), self.known
        hits, matches = [], []
        inside = [w in known for w in text_words]
        n, i = len(text_words), 0
        while True:
            try:
                i = inside.index(True, i)
            except ValueError:
                break
            try:
                j = inside.index(False, i)
            except ValueError:
                j = n
            if j - i >= min(self.shortest, LONG):
                self._stream(text_words[i:j], i, hits, matches)
            i = j
        return n, hits, self._chain(matches)

    def _stream(self, run: list[bytes], at: int, hits: list, matches: list) -> None:
        before = (0, 0)
        for k, (state, length) in enumerate(self.automaton.run(run)):
            for t in self.ending[state]:
                if length >= len(self.sequences[t]):
                    hits.append((at + k - len(self.sequences[t]) + 1, t))
            if length <= before[1] and before[1] >= LONG:  # the match before ended: it is maximal
                matches.append((at + k, before[1], before[0]))
            before = (state, length)
        if before[1] >= LONG:
            matches.append((at + len(run), before[1], before[0]))

    def _chain(self, matches: list[tuple[int, int, int]]) -> dict[str, float]:
        """matches: (end, exclusive, length, state) in the text, in order."""
        best: dict[str, float] = {}
        of: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, length, state in matches:
            for t, position in self.places[state]:
                of[t].append((end - length, position + 1 - length, length))
        for t, found in of.items():
            need, chains = len(self.sequences[t]), []
            for start, position, length in found:
                covered = length
                for s, p, n, c in reversed(chains):  # their ends do not fall
                    if s + n < start - SKIP:
                        break
                    gap, skip = start - (s + n), position - (p + n)
                    if -length < gap <= SKIP and -length < skip <= SKIP and s < start and p < position:
                        covered = max(covered, c + length + min(gap, skip, 0))
                chains.append((start, position, length, covered))
            share = max(c[3] for c in chains) / need
            if t < self.n_phrases and share < 1:
                continue
            label = self.labels[t].removesuffix("-notice")
            best[label] = max(best.get(label, 0.0), min(1.0, share))
        return {label: x for label, x in best.items() if x >= COVERED}


@lru_cache(4)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


def licences(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row.

    n_base counts all places of phrases; first_word and last_word are their smallest and largest start, null if there are none. score is the best cover of a
    reported template or phrase, 0 where nothing is reported. Null and empty texts have no words. Rows with null or repeated doc_ids each come back; other columns are not read.
    """
    chosen = tuple((PHRASES if phrases is None else phrases).items()), tuple((TEMPLATES if templates is None else templates).items())

    def make():
        scanner = _scanner(*chosen)

        def one(doc_id, text):
            n, hits, covers = scanner.scan(text)
            base = sorted({scanner.labels[t] for _, t in hits})
            starts = [s for s, _ in hits]
            score = 1.0 if hits else max(covers.values(), default=0.0)
            return doc_id, n, len(hits), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *covers})), score

        return one

    return per_row(texts(docs), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make, "doc_id", "text")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
