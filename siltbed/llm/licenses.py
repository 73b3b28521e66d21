"""License scans by template markup.

A template is plain wording with two kinds of marks: ``[[ ... ]]`` may be
left out, ``{{n}}`` stands for one to n words of any kind, such as the name of a
holder.  Templates are whole bodies of short licences and the notices by which
files refer to long ones.  Their text is split into words like a document's,
so case and punctuation do not matter.  Each template is
compiled into an automaton over words; a text matches where the automaton
accepts, so every mandatory word must be there, in order, and nothing else
between.  Of several ends from one start the furthest counts.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
Base phrases are counted wherever their words stand consecutively.

Defined cases: null and empty texts have no words, score 0 and null places;
very long texts are scanned whole; matches that overlap or tie all give their
labels, and a word inside several counts once; repeated rows are scanned each
by itself; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import LOWER, slices, word_table

#: Fixed values of the scan's contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and wording of public licences and notices, with marks.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """[[3]] Neither the name of {{12}} nor the names of [[its]] [[the]] [[contributors]] {{4}} may be used to endorse or promote products derived from this
software without specific prior written permission."""
_GNU_REST = """[[This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {{2}} General Public License for more details.
[[You should have received a copy of the GNU {{2}} General Public License along with this program; if not, {{16}}]]]]"""
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the Software. """ + _WARRANTY + """ AND
NONINFRINGEMENT. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this {{6}} and associated documentation files [[the {{4}}]] to deal in the {{4}} without restriction",
    "mit-reference": "[[released]] [[distributed]] [[licensed]] under the [[terms of the]] mit license",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{4}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{4}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": _BSD_HEAD + " " + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + " " + _BSD_NAMES + " " + _BSD_TAIL,
    "bsd-clauses": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: [[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2]] Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. [[3]] This notice may not be removed or altered from any source distribution.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the
above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. """ + _WARRANTY + """,
TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. [[In jurisdictions that recognize copyright
laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.]]""",
    "apache-2.0": "licensed under the apache license version 2 0 [[the license [[you may not use this file except in compliance with the license]] [[you may obtain a copy of the license at {{12}}]]]]",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at {{12}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at {{8}}""",
    "epl-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License [[v]] 2.0 which [[accompanies this distribution and]]
is available at {{10}}""",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or at your option any later version]]",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or at your option any later version]]",
    "gpl-3.0-header": """{{8}} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, [[either]] version 3 of the License [[or (at your option) any later version]]. """ + _GNU_REST,
    "gpl-2.0-header": """{{8}} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; [[either]] version 2 of the License [[or (at your option) any later version]]. """ + _GNU_REST,
    "lgpl-header": """{{8}} is free software; you can redistribute it and/or modify it under the terms of the GNU {{1}} General Public License as published by the Free Software
Foundation; [[either]] version {{3}} of the License [[or (at your option) any later version]]. """ + _GNU_REST,
    "agpl-3.0-header": """{{8}} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software
Foundation, [[either]] version 3 of the License [[or (at your option) any later version]]. """ + _GNU_REST,
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0 [[international]] [[license]]",
    "cc-by": "licensed under [[a]] [[the]] creative commons attribution [[share alike]] [[sharealike]] {{2}} [[international]] [[unported]] license",
}
MEMBER = np.zeros(256, bool)
MEMBER[48:58] = MEMBER[97:123] = MEMBER[128:] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _marks(template: str) -> list[str]:
    """The marks and words of a template; its words are those that a document with that text has."""
    out = []
    for part in re.split(r"(\[\[|\]\]|\{\{[0-9]+\}\})", template):
        if part[:2] in ("[[", "]]", "{{"):
            out.append(part)
        else:
            out += [w.decode() for w in _WORD.findall(part.encode().lower())]
    return out


class Automaton:
    """States 0..n; ``step`` by a given word, ``free`` without one, ``wild`` by any word."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.wild: list[set[int]] = [set()]
        opened: list[int] = []
        here = 0
        for mark in _marks(template):
            if mark == "[[":
                opened.append(here)
            elif mark == "]]":
                here = self._skip(opened.pop(), here)
            elif mark[0] == "{":
                most = int(mark[2:-2])
                ends = []
                for _ in range(most):
                    following = self._state()
                    self.wild[here].add(following)
                    here = following
                    ends.append(here)
                for end in ends[:-1]:
                    self.free[end].add(here)
            else:
                following = self._state()
                self.step[here].setdefault(mark.encode(), set()).add(following)
                here = following
        if opened:
            raise ValueError("a [[ is not closed")
        self.end = here
        self.begin = frozenset(self._spread({0}))
        self.first = {w for s in self.begin for w in self.step[s]}
        #: Words that may stand before the first mandatory one, where a template begins with any words.
        self.ahead = 0
        states = set(self.begin)
        while any(self.wild[s] for s in states):
            states = self._spread({t for s in states for t in self.wild[s]})
            self.ahead += 1
            self.first |= {w for s in states for w in self.step[s]}

    def _state(self) -> int:
        for table in (self.step, self.free, self.wild):
            table.append({} if table is self.step else set())
        return len(self.step) - 1

    def _skip(self, start: int, end: int) -> int:
        joined = self._state()
        self.free[start].add(joined)
        self.free[end].add(joined)
        return joined

    def _spread(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """The furthest end of a match that begins at word ``at``, or -1."""
        states, found = set(self.begin), -1
        while states:
            if self.end in states:
                found = at
            if at == len(words):
                break
            after: set[int] = set()
            for s in states:
                after |= self.wild[s]
                after |= self.step[s].get(words[at], set())
            states, at = self._spread(after), at + 1
        return found


def _scan(words: list[bytes], base: dict[tuple[bytes, ...], str], automata: dict[str, Automaton]) -> tuple:
    places, base_labels = [], set()
    where: dict[bytes, list[int]] = {}
    wanted = {k[0] for k in base} | {w for a in automata.values() for w in a.first}
    for i, w in enumerate(words):
        if w in wanted:
            where.setdefault(w, []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for phrase, label in base.items():
        for i in where.get(phrase[0], ()):
            if tuple(words[i : i + len(phrase)]) == phrase:
                places.append(i)
                base_labels.add(label)
                covered[i] += 1
                covered[i + len(phrase)] -= 1
    labels = set(base_labels)
    for label, automaton in automata.items():
        near = {i for w in automaton.first for i in where.get(w, ())}
        if automaton.ahead:
            near = {j for i in near for j in range(max(i - automaton.ahead, 0), i + 1)}
        for i in sorted(near):
            if (end := automaton.match(words, i)) >= 0:
                labels.add(label)
                covered[i] += 1
                covered[end] -= 1
    share = float((np.cumsum(covered) > 0).sum()) / len(words)
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), share


def _scan_batches(batches: Iterable[pa.RecordBatch], base: dict[str, str], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    phrases = {tuple(k.encode().split()): v for k, v in base.items()}
    automata = {k: Automaton(v) for k, v in templates.items()}
    #: A text without any first word of a phrase or template has no match.
    first = re.compile(b"|".join(sorted({re.escape(k[0]) for k in phrases} | {re.escape(w) for a in automata.values() for w in a.first})))
    plain = (0, None, None, "", "", 0.0)
    for rows, offsets, data in slices(batches):
        data = LOWER[data]
        _, _, at = word_table(offsets, data, MEMBER)
        raw, found = data.tobytes(), []
        for i in range(rows.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            found.append(_scan(_WORD.findall(text), phrases, automata) if at[i + 1] > at[i] and _may_match(text, first) else plain)
        columns = list(zip(*found, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at).astype(np.int64)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def _may_match(text: bytes, first: re.Pattern) -> bool:
    return first.search(text) is not None


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (share of words inside matches)."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _scan_batches(it, base, templates), SCHEMA)
