"""Whole license texts: as published, with a changed word anywhere, and against templates as regular expressions."""

import random
import re

import pytest

from lexmill.llm import licenses

MIT = """The MIT License (MIT)

Copyright (c) 2021 Some Body <some@body.org>

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
# the License. You may obtain a copy of the License at
#    http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
# limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
 * You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def pieces(template):
    return re.findall(r"<<[^>]*>>|[^\s<]+", template)


def pattern(template):
    """The template as a regular expression over words that a blank follows."""
    out = []
    for item in pieces(template):
        out.append({"<<optional>>": "(?:", "<<end>>": ")?"}.get(item) or (rf"(?:[^ ]+ ){{0,{int(item[5:-2])}}}" if item.startswith("<<var") else re.escape(item) + " "))
    return re.compile("(?:^|(?<= ))" + "".join(out))


PATTERNS = {label: pattern(t) for label, t in licenses.TEMPLATES.items()}


def labels(tokens):
    line = "".join(w + " " for w in tokens)
    return {label for label, p in PATTERNS.items() if p.search(line)}


def sample(template, rng, everything):
    """A text that the template accepts, and which of its words are mandatory."""
    words, mandatory, hidden = [], [], []
    for item in pieces(template):
        if item == "<<optional>>":
            hidden.append(not everything and rng.random() < 0.5)
        elif item == "<<end>>":
            hidden.pop()
        elif any(hidden):
            continue
        elif item.startswith("<<var"):
            words += ["someone"] * rng.randint(1, int(item[5:-2]))
        else:
            if not hidden:
                mandatory.append(len(words))
            words.append(item)
    return words, mandatory


@pytest.fixture(scope="module")
def automaton():
    return licenses.Automaton(licenses.TEMPLATES)


def found(automaton, words):
    return set(automaton.scan([w.encode() for w in words]))


@pytest.mark.parametrize(("label", "text"), [("mit-text", MIT), ("bsd-3-clause-text", BSD3), ("apache-2.0-header", APACHE), ("gpl-header", GPL)])
def test_published_texts(automaton, label, text):
    words = licenses.words("/* " + text + "\n*/ int main")
    assert label in automaton.scan(words)
    at = len(words) - 25
    assert label not in automaton.scan([*words[:at], b"hardly", *words[at + 1 :]])
    assert label not in automaton.scan(words[:-25])


def test_two_clauses_are_not_three(automaton):
    assert "bsd-2-clause-text" not in automaton.scan(licenses.words(BSD3))
    two = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
    assert {"bsd-2-clause-text"} == {label for label in automaton.scan(licenses.words(two)) if label.endswith("-text")}


@pytest.mark.parametrize("label", licenses.WHOLE)
def test_any_changed_mandatory_word_refuses_the_label(automaton, label):
    rng = random.Random(label)
    for everything in (True, False):
        words, mandatory = sample(licenses.WHOLE[label], rng, everything)
        assert label in found(automaton, ["x", *words, "y"])
        assert len(mandatory) > 60
        for i in mandatory:
            assert label not in found(automaton, [*words[:i], "changed", *words[i + 1 :]]), words[i]
            assert label not in found(automaton, words[:i]), words[i]


def test_against_regular_expressions(automaton):
    rng, known = random.Random(3), sorted(w.decode() for w in automaton.known)
    for n in range(400):
        words = []
        for label in rng.choices(list(licenses.TEMPLATES), k=rng.randint(1, 3)):
            words += sample(licenses.TEMPLATES[label], rng, False)[0] + rng.choices(known, k=rng.randint(0, 3))
        for _ in range(n % 4):
            i = rng.randrange(len(words))
            words[i : i + rng.randint(0, 1)] = rng.choices(known, k=rng.randint(0, 1))
        assert found(automaton, words) == labels(words)


def test_scores(spark):
    changed = MIT.replace("AUTHORS OR COPYRIGHT", "NEIGHBOURS OR COPYRIGHT")
    rows = [(0, MIT), (1, changed), (2, "under the MIT License"), (3, "nothing"), (4, None)]
    got = {r.doc_id: (r.score, set(filter(None, r.labels.split(",")))) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (1.0, {"mit", "mit-opening", "mit-text"}), 1: (0.75, {"mit", "mit-opening"}), 2: (0.5, {"mit"}), 3: (0.0, set()), 4: (0.0, set())}
