"""Licence texts and phrases in documents.

A generalised suffix automaton is built over the word ids of the licence
templates. A document's words stream through it, which gives at every word the
longest run ending there that stands in some template (matching statistics).
Runs of at least ``MIN_RUN`` words are chained in order of both texts; a
template of which a chain covers ``COVER`` or more is a label of its own, unless a
template that much of it also stands in (two licences of one family) is covered
better. The
templates are a fixed, small parameter, so the automaton's size is bounded.

Only stretches of ``MIN_RUN`` or more words that all occur in templates can
hold such runs, so these alone are streamed; everywhere else the statistic is
below ``MIN_RUN``.

Base labels come from phrases of consecutive words. Words are lower-cased
(A-Z). ``score`` is the largest covered share of a template. Null texts have no
words, no labels and score 0. Repeated rows and ids stay; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnmark.llm import ragged

MIN_RUN, COVER, GAP = 5, 0.5, 30
#: Phrases and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public licence texts and the labels of their templates.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-warranty": "The Software is provided AS IS, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "apache-grants": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted.",
    "gpl2-text": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
    "agpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.",
    "gpl-preamble": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things.",
    "mpl-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-text": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "cc-by-text": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "cc-by-sa-text": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "epl-text": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "ofl-text": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL",
}


def _word_hashes(data: np.ndarray, offs: np.ndarray):
    low = ragged.LOWER[data]
    starts, ends, first = ragged.words(low, offs, ragged.ALNUM)
    return ragged.span_hash(ragged.prefix(low), starts, ends), first


def _hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _word_hashes(data, np.array([0, len(data)]))[0]


class Automaton:
    """Generalised suffix automaton of the templates' word ids."""

    def __init__(self, templates: dict[str, str]):
        self.labels = list(templates)
        hashes = [_hashes_of(t) for t in templates.values()]
        self.sizes = [len(h) for h in hashes]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]  # template to the ends of the state's runs in it
        for t, h in enumerate(hashes):
            last = 0
            for i, word in enumerate(np.searchsorted(self.vocabulary, h).tolist()):
                last = self._add(last, word)
                self.ends[last].setdefault(t, set()).add(i + 1)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for t, ends in self.ends[s].items():
                self.ends[self.link[s]].setdefault(t, set()).update(ends)
        #: Of each template those whose own text would be taken for it.
        self.rivals: list[set[int]] = [set() for _ in hashes]
        for u, h in enumerate(hashes):
            for t, covered in self.covers(self.runs(np.searchsorted(self.vocabulary, h).tolist(), MIN_RUN), GAP).items():
                if t != u and covered >= COVER * self.sizes[t]:
                    self.rivals[t].add(u)

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, word: int) -> int:
        q = self.next[p][word]
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, word)
        return new

    def runs(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of the runs of ``least`` words or more that cannot be extended to the right."""
        out, state, length = [], 0, 0
        for i, word in enumerate(words):
            if word not in self.next[state] and length >= least:
                out.append((i, length, state))
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                length = 0
        if length >= least:
            out.append((len(words), length, state))
        return out

    def covers(self, runs: list[tuple[int, int, int]], gap: int) -> dict[int, int]:
        """Most words of each template that a chain of runs covers, in the order of both texts."""
        best: dict[int, int] = {}
        for t, size in enumerate(self.sizes):
            chain: list[tuple[int, int, int]] = []  # end in the document, end in the template, covered
            for end, length, state in runs:
                near = chain[bisect_left(chain, end - length - gap, key=lambda c: c[0]) :]
                for at in sorted(self.ends[state].get(t, ())):
                    most = length
                    for d, e, covered in near:
                        fresh = min(length, at - e, end - d)
                        if fresh > 0:
                            most = max(most, covered + fresh)
                    chain.append((end, at, most))
                    best[t] = max(best.get(t, 0), min(most, size))
        return best


@lru_cache(maxsize=4)
def _automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(dict(templates))


def _places(hashes: np.ndarray, owner: np.ndarray, phrase: str) -> np.ndarray:
    wanted = _hashes_of(phrase)
    n = len(hashes) - len(wanted) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    here = owner[:n] == owner[len(wanted) - 1 :]
    for j, h in enumerate(wanted):
        here &= hashes[j : j + n] == h
    return np.flatnonzero(here)


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs`` (doc_id, text)."""
    picked, fixed = docs.select("doc_id", "text"), tuple(templates.items())

    def work(rows, data, offs):
        hashes, first = _word_hashes(data, offs)
        owner = np.repeat(np.arange(rows.num_rows), np.diff(first))
        n_base = np.zeros(rows.num_rows, np.int64)
        low, high = np.full(rows.num_rows, np.iinfo(np.int64).max), np.full(rows.num_rows, -1)
        base: list[set[str]] = [set() for _ in range(rows.num_rows)]
        for phrase, label in phrases.items():
            at = _places(hashes, owner, phrase)
            row = owner[at]
            np.add.at(n_base, row, 1)
            np.minimum.at(low, row, at - first[row])
            np.maximum.at(high, row, at - first[row])
            for r in np.unique(row).tolist():
                base[r].add(label)
        automaton = _automaton(fixed)
        known = np.minimum(np.searchsorted(automaton.vocabulary, hashes), max(len(automaton.vocabulary) - 1, 0))
        inside = automaton.vocabulary[known] == hashes if len(automaton.vocabulary) else np.zeros(len(hashes), bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        if len(edges):  # stretches also end with their text
            bounds = np.unique(np.concatenate([edges, first[(first > 0) & (first < len(hashes))]]))
            begin, stop = bounds[:-1], bounds[1:]
            pick = inside[begin] & (stop - begin >= MIN_RUN)
            begin, stop = begin[pick], stop[pick]
        else:
            begin = stop = edges
        runs: dict[int, list] = {}
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            row = int(owner[a])
            shift = a - int(first[row])
            for end, length, state in automaton.runs(known[a:b].tolist(), MIN_RUN):
                runs.setdefault(row, []).append((end + shift, length, state))
        score, labels = np.zeros(rows.num_rows), [set(x) for x in base]
        for row, found in runs.items():
            shares = {t: covered / automaton.sizes[t] for t, covered in automaton.covers(found, GAP).items()}
            score[row] = max(shares.values(), default=0.0)
            for t, share in shares.items():
                if share >= cover and all(share >= shares.get(u, 0) for u in automaton.rivals[t]):
                    labels[row].add(automaton.labels[t])
        none = n_base == 0
        text = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none), text(base), text(labels), pa.array(score)],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(ragged.mapper(work), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
