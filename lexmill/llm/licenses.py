"""License scans by template markup compiled to token automata.

A template is plain wording with ``<<optional>>...<<end>>`` regions, which a text may leave
out, and ``<<var N>>`` places, which stand for up to N words of any kind. All other words are
mandatory and must match exactly, in order and without gaps. The templates together compile to
one nondeterministic automaton over words; sets of its states are determinised when a text
first reaches them. A text is accepted at each place where a template's end is reached.

Labels ending in ``-text`` and ``-header`` stand for the whole wording: one mandatory word changed
anywhere, and they aren't given. ``-opening`` says only that a text begins like a license's. The
texts of the GPL, LGPL, MPL and Apache licenses themselves are known by openings and notices.

Beside the templates, base phrases are counted wherever their words stand consecutively.

Defined results: null texts are empty; empty texts have no words and no labels (empty strings,
score 0); repeated rows are scanned each for itself; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of public license notices, and of the parts that license texts begin with.
TEMPLATES = {
    "mit-notice": "<<optional>>this <<var 4>> is<<end>> released under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 <<optional>>the license you may not use this file except in compliance with the license<<end>>",
    "gpl-notice": "<<optional>>this <<var 4>> is<<end>> licensed under the gnu general public license <<optional>>version <<var 1>><<end>>",
    "cc-by-notice": "<<optional>>this <<var 4>> is<<end>> licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by <<optional>>nc<<end>> <<optional>>sa<<end>> <<optional>>nd<<end>> <<optional>>4 0<<end>>",
    "mit-opening": (
        "<<optional>>mit license<<end>> <<optional>>copyright <<var 12>><<end>> permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the"
        " above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software"
    ),
    "isc-opening": (
        "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above"
        " copyright notice and this permission notice appear in all copies"
    ),
    "bsd-opening": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>>"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " <<optional>><<optional>>and<<end>> <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution<<end>>"
    ),
    "bsd-endorsement-clause": "neither the name of <<var 12>> nor the names of <<var 3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-2.0-terms": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-terms": (
        "<<optional>>this program is<<end>> free software you can redistribute it and or modify it under the terms of the gnu <<optional>>affero<<end>> <<optional>>lesser<<end>> <<optional>>library<<end>>"
        " general public license as published by the free software foundation <<optional>>either<<end>> version <<var 2>> of the license <<optional>>or at your option any later version<<end>>"
    ),
    "gpl-3.0-opening": (
        "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away"
        " your freedom to share and change the works"
    ),
    "lgpl-3.0-opening": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
        " <<optional>>http<<end>> <<optional>>https<<end>> mozilla org mpl 2 0"
    ),
    "cc-notice": (
        "licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution <<optional>>non commercial<<end>> <<optional>>noncommercial<<end>> <<optional>>share alike<<end>>"
        " <<optional>>sharealike<<end>> <<optional>>no derivatives<<end>> <<optional>>noderivatives<<end>> <<var 2>> <<optional>>international<<end>> <<optional>>unported<<end>> license"
    ),
    "cc0-notice": "has waived all copyright and related or neighboring rights to <<var 12>> <<optional>>worldwide<<end>>",
    "unlicense-opening": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form"
        " or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "zlib-opening": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " <<optional>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software"
    ),
    "boost-opening": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use"
        " reproduce display distribute execute and transmit the software and to prepare derivative works of the software"
    ),
}

_SOFTWARE_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
    " and noninfringement in no event shall the <<optional>>authors<<end>> <<optional>>or<<end>> <<optional>>copyright holders<<end>> be liable for any claim damages or other liability whether in an action of contract"
    " tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_ISC_WARRANTY = (
    "the software is provided as is and <<var 8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    " in no event shall <<var 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
    " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>>"
    " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>and<<end>> <<optional>>2<<end>>"
    " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"
    " provided with the distribution"
)
_BSD_WARRANTY = (
    "this software is provided by <<var 8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose"
    " are disclaimed in no event shall <<var 8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods"
    " or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise"
    " arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Whole license texts, and the whole notices that files carry for licenses too long to carry.
WHOLE = {
    "mit-text": f"{TEMPLATES['mit-opening']} {_SOFTWARE_WARRANTY}",
    "isc-text": f"{TEMPLATES['isc-opening']} {_ISC_WARRANTY}",
    "0bsd-text": f"permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted {_ISC_WARRANTY}",
    "bsd-2-clause-text": f"{_BSD_CONDITIONS} {_BSD_WARRANTY}",
    "bsd-3-clause-text": f"{_BSD_CONDITIONS} <<optional>>and<<end>> <<optional>>3<<end>> {TEMPLATES['bsd-endorsement-clause']} {_BSD_WARRANTY}",
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the <<optional>>authors<<end>> <<optional>>author<<end>> be held liable for any damages arising from the use of this software"
        f" {TEMPLATES['zlib-opening']} if you use this software in a product an <<optional>>acknowledgment<<end>> <<optional>>acknowledgement<<end>> in the product documentation would be appreciated but is not required"
        " <<optional>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " <<optional>>3<<end>> this notice may not be removed or altered from any source distribution"
    ),
    "boost-text": (
        f"<<optional>>boost software license version 1 0 august 17th 2003<<end>> {TEMPLATES['boost-opening']} and to permit third parties to whom the software is furnished to do so all subject to the following"
        " the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software"
        " in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement"
        " in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with"
        " the software or the use or other dealings in the software"
    ),
    "unlicense-text": (
        f"{TEMPLATES['unlicense-opening']} in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
        " we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity"
        f" of all present and future rights to this software under copyright law {_SOFTWARE_WARRANTY}"
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        f" <<optional>>http<<end>> <<optional>>https<<end>> www apache org licenses license 2 0 {TEMPLATES['apache-2.0-terms']}"
    ),
    "gpl-header": (
        f"{TEMPLATES['gpl-terms']} <<var 6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
        " see the gnu <<optional>>affero<<end>> <<optional>>lesser<<end>> <<optional>>library<<end>> general public license for more details you should have received a copy of the gnu"
        " <<optional>>affero<<end>> <<optional>>lesser<<end>> <<optional>>library<<end>> general public license along with <<var 6>> if not"
    ),
}
TEMPLATES |= WHOLE

#: Bytes of words stay, A-Z become lower case, all others become spaces.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Templates as one automaton; ``accepting`` maps a state to its template's label."""

    def __init__(self, templates: dict[str, str], max_sets: int = 50_000):
        self.on: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []  # where any word leads
        self.free: list[list[int]] = []  # where no word leads
        self.accepting: dict[int, str] = {}
        self.max_sets = max_sets
        starts = []
        for label, template in templates.items():
            at = self._state()
            starts.append(at)
            opened: list[int] = []
            for item in re.findall(r"<<[^>]*>>|[^\s<]+", template):
                if item == "<<optional>>":
                    opened.append(at)
                elif item == "<<end>>":
                    nxt = self._state()
                    self.free[at].append(nxt)
                    self.free[opened.pop()].append(nxt)
                    at = nxt
                elif item.startswith("<<var"):
                    end = self._state()
                    for _ in range(int(item[5:-2])):
                        nxt = self._state()
                        self.free[at].append(end)
                        self.any[at].append(nxt)
                        at = nxt
                    self.free[at].append(end)
                    at = end
                else:
                    nxt = self._state()
                    self.on[at].setdefault(item.encode(), []).append(nxt)
                    at = nxt
            if opened:
                raise ValueError(f"an optional region of {label} isn't closed")
            self.accepting[at] = label
        self.known = {w for d in self.on for w in d}
        self.start = self._closed(starts)
        self.first = {w for s in self.start for w in self.on[s]}
        if any(self.any[s] for s in self.start):
            raise ValueError("a template must begin with a word")
        self.moves: dict[tuple[frozenset, bytes], tuple[frozenset, frozenset]] = {}

    def _state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.free.append([])
        return len(self.on) - 1

    def _closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> tuple[frozenset, frozenset]:
        key = (states, word if word in self.known else b"")
        found = self.moves.get(key)
        if found is None:
            if len(self.moves) >= self.max_sets:
                self.moves.clear()
            after = self._closed([n for s in states for n in (*self.on[s].get(key[1], ()), *self.any[s])])
            found = self.moves[key] = (after, frozenset(self.accepting[s] for s in after if s in self.accepting))
        return found

    def scan(self, tokens: list[bytes]) -> dict[str, tuple[int, int]]:
        """The first accepted span (first word, words) of each label, as long as it goes."""
        found: dict[str, tuple[int, int]] = {}
        for start in [i for i, w in enumerate(tokens) if w in self.first]:
            states = self.start
            for i in range(start, len(tokens)):
                states, labels = self.step(states, tokens[i])
                for label in labels:
                    if label not in found or found[label][0] == start:
                        found[label] = (start, i + 1 - start)
                if not states:
                    break
        return found


def places(tokens: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """``(first word, label)`` of all places where a phrase's words stand consecutively."""
    line = b" " + b" ".join(tokens) + b" "
    found = []
    for phrase, label in phrases.items():
        want = b" " + phrase.encode() + b" "
        at, counted, n = line.find(want), 0, 0
        while at >= 0:
            n += line.count(b" ", counted, at)
            counted = at
            found.append((n, label))
            at = line.find(want, at + 1)
    return found


def score(spans: dict, base: list) -> float:
    if any(not label.endswith("-opening") for label in spans):
        return 1.0
    return 0.75 if spans else 0.5 if base else 0.0


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` for each row.

    score is 1 where a template is accepted, 3/4 where only openings are, one half where only phrases were found, else 0;
    spans has label, first word and number of words of each accepted template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for batch in batches:
            out = [[] for _ in range(8)]
            for text in batch.column(1):
                tokens = words(text.as_py())
                base = places(tokens, phrases)
                spans = automaton.scan(tokens)
                own = {label for _, label in base}
                at = [i for i, _ in base]
                for column, x in zip(
                    out,
                    (len(tokens), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | spans.keys())), score(spans, base),
                     [{"label": k, "first": a, "n": n} for k, (a, n) in sorted(spans.items())]),
                    strict=True,
                ):
                    column.append(x)
            span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,n:long>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
