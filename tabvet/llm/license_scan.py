"""License scans with a generalised suffix automaton.

The automaton of all licence templates' tokens is small and travels with the
task. Each text streams through it once; at every word it knows the longest
run of words that ends there and stands in some template. Long runs are
chained, per template, into spans in template order, and a template is
reported when its chain covers enough of it.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import as_bytes, prepare

# Phrases whose every place counts, the wording of licences and of
# their notices, and identifiers that stand for a licence in a file's head.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF "
            "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
            "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR "
            "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
            "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
            "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                     "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED "
                     "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
                     "PURPOSE ARE DISCLAIMED."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
            "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
)
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                   "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "The MIT License (MIT)"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
SPDX = ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0",
        "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
TEMPLATES = (*TEXTS, *NOTICES, *((x.lower(), f"SPDX-License-Identifier: {x}") for x in SPDX),
             *((f"cc-{kind.lower()}", f"Licensed under CC {kind} {version}")
               for kind in ("BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("2.0", "2.5", "3.0", "4.0")))
MIN_RUN = 3       # words of a run that may join a chain
MAX_GAP = 8       # words of the text between two runs of a chain
COVERED = 0.75    # share of a template's words that its chain must cover,
SHORT = 8         # all of them in a template of so many words or fewer

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z."""
    return text.translate(_CLEAN).split()


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``sources`` are (label, words, is_phrase). For each state it holds the
    places (source, end) where its words end in a source, the whole phrases
    among its suffixes, and what each place of a suffix is worth.
    """

    def __init__(self, sources: list[tuple[str, list[bytes], bool]]):
        self.sources = sources
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for s, (_, tokens, _) in enumerate(sources):
            last = 0
            for end, token in enumerate(tokens, 1):
                last = self._extend(last, self.vocabulary.setdefault(token, len(self.vocabulary)))
                self.places[last].add((s, end))
        own = [[(s, end) for s, end in sorted(p) if sources[s][2] and end == len(sources[s][1])] for p in self.places]
        for state in sorted(range(1, len(self.link)), key=lambda v: -self.longest[v]):
            self.places[self.link[state]] |= self.places[state]
        self.whole = own
        for state in sorted(range(1, len(self.link)), key=lambda v: self.longest[v]):
            self.whole[state] = self.whole[self.link[state]] + own[state]
        # (source, end, the word that would extend it, longest) of each place on a state's way to the
        # root, with the longest run that ends there; 0 stands for the run that was matched.
        self.credits: list[list[tuple[int, int, int, int]]] = []
        for state in range(len(self.link)):
            seen, own, at = set(), [], state
            while at > 0:
                for s, end in sorted(self.places[at] - seen):
                    tokens = sources[s][1]
                    if not sources[s][2]:
                        own.append((s, end, self.vocabulary[tokens[end]] if end < len(tokens) else -1, 0 if at == state else self.longest[at]))
                seen |= self.places[at]
                at = self.link[at]
            self.credits.append(own)

    def _state(self, longest: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.longest.append(longest)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, parent: int, token: int, child: int) -> int:
        """The state reached from ``parent`` whose longest string is one word longer than the parent's."""
        if self.longest[child] == self.longest[parent] + 1:
            return child
        copy = self._state(self.longest[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(token) == child:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new, at = self._state(self.longest[last] + 1, 0, {}), last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, token, self.next[at][token])
        return new

    def statistics(self, tokens: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) wherever a run of template words ends; other positions have none."""
        number, nxt, link, longest = self.vocabulary, self.next, self.link, self.longest
        state = length = 0
        for i, token in enumerate(map(number.get, tokens)):
            if token is None:
                state = length = 0
                continue
            while state and token not in nxt[state]:
                state = link[state]
                length = longest[state]
            if token in nxt[state]:
                state = nxt[state][token]
                length += 1
                yield i, state, length
            else:
                state = length = 0


@lru_cache(maxsize=4)
def automaton(phrases: tuple, templates: tuple) -> Automaton:
    return Automaton([(label, words(t.encode()), True) for label, t in phrases] + [(label, words(t.encode()), False) for label, t in templates])


def runs(auto: Automaton, tokens: list[bytes], stats: list[tuple[int, int, int]], min_run: int) -> Iterator[tuple[int, int, int, int]]:
    """(source, end in the source, first word, end word) of every run of ``min_run``
    words or more that a text and a template share and neither side can extend
    to the right: for each end in a template the longest, whatever longer runs
    other templates have there."""
    number = auto.vocabulary.get
    for i, state, length in stats:
        if length < min_run:
            continue
        following = number(tokens[i + 1], -2) if i + 1 < len(tokens) else -2
        for s, end, token, longest in auto.credits[state]:
            if 0 < longest < min_run:  # longest runs come first
                break
            n = min(longest, length) if longest else length
            if token != following:
                yield s, end, i + 1 - n, i + 1


def chains(found: Iterator[tuple[int, int, int, int]], max_gap: int) -> list[tuple[int, int, int, int]]:
    """(source, first word, end word, words covered): best chain of each template.

    ``found`` are runs by their end. A run joins the chain before it when it
    follows in text and template and the gap is small; words it shares with
    the chain, in text or template, count once.
    """
    open_: dict[int, list[int]] = {}
    best: dict[int, tuple[int, int, int]] = {}
    for s, end, start, stop in found:
        chain, length = open_.get(s), stop - start
        if chain and end > chain[2] and start - chain[1] <= max_gap and stop > chain[1]:
            fresh = min(stop - max(start, chain[1]), end - max(end - length, chain[2]))
            chain[1], chain[2], chain[3] = stop, end, chain[3] + fresh
        else:
            chain = open_[s] = [start, stop, end, length]
        if s not in best or chain[3] > best[s][2]:
            best[s] = (chain[0], chain[1], chain[3])
    return [(s, *x) for s, x in sorted(best.items())]


def scan_text(text: bytes, auto: Automaton, min_run: int, max_gap: int, covered: float) -> dict:
    tokens = words(text)
    stats = list(auto.statistics(tokens))
    places = defaultdict(list)
    for i, state, length in stats:
        for s, n in auto.whole[state]:
            if n <= length:
                places[s].append(i + 1 - n)
    starts = [x for p in places.values() for x in p]
    base = sorted({auto.sources[s][0] for s in places})
    spans, score = [], 0.0
    for s, start, stop, n in chains(runs(auto, tokens, stats, min_run), max_gap):
        size = len(auto.sources[s][1])
        share = n / size
        if share >= (covered if size > SHORT else 1):
            spans.append({"label": auto.sources[s][0], "start": start, "stop": stop, "share": share})
            score = max(score, share)
    return {"n_words": len(tokens), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(x["label"] for x in spans)})),
            "score": 1.0 if base else score, "spans": spans}


SCHEMA = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
          "spans array<struct<label:string,start:bigint,stop:bigint,share:double>>")
_ARROW = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
          ("labels", pa.string()), ("score", pa.float64()),
          ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])))]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES,
         min_run: int = MIN_RUN, max_gap: int = MAX_GAP, covered: float = COVERED) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts and labels of the
    phrases, labels and score of phrases and templates, and the templates'
    covered spans in words.

    A phrase counts at every place where its words stand one after the other;
    the score is 1 with a phrase, else the largest covered share of a reported
    template, else 0. Null and empty texts have no words, no places and score
    0. Repeated rows are scanned each; extra columns are not read; an empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(phrases, templates)
        for batch in batches:
            rows = [scan_text(t, auto, min_run, max_gap, covered) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], t) for c, t in _ARROW)],
                                             ["doc_id", *(c for c, _ in _ARROW)])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def digest_columns(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
