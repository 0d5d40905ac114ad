"""License scans: templates with optional and replaceable regions, matched as token automata.

A template is wording with markup::

    <<optional>> ... <<end>>      words that may be absent, all or none
    <<var:7>>                     up to seven words of any kind

It is compiled into an automaton over words.  A place of a text is accepted if a walk
from the start state, word by word, reaches the end: the mandatory wording then stands
there exactly, in order, with nothing between but what the markup allows.  The first word of
a template is mandatory; walks start only where the first mandatory words stand.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, map_texts

#: Fixed phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed wording of public notices and license texts, in template markup: fixed values.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 <<optional>> the license <<end>> <<optional>> you may not use this file except in compliance with the license <<end>>",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this <<var:4>> to deal in the <<var:4>> without restriction",
    "mit-named": "under the <<optional>> terms of the <<end>> mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted <<optional>> provided that the following conditions are met <<end>>",
    "gpl-notice": "licensed under the <<optional>> terms of the <<end>> gnu <<optional>> lesser <<end>> <<optional>> affero <<end>> general public license <<optional>> as published by the free software foundation <<end>> <<optional>> version <<var:1>> <<end>>",
    "cc-by-notice": "licensed under <<optional>> a <<end>> <<optional>> the <<end>> <<optional>> creative commons <<end>> cc by <<optional>> nc <<end>> <<optional>> sa <<end>> <<optional>> nd <<end>> <<optional>> <<var:1>> 0 <<end>>",
    "copyright-reserved": "copyright <<var:7>> all rights reserved",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var:1>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice <<optional>> (including the next paragraph) <<end>> shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:12>> BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<optional>> 1. <<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<optional>> 2. <<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. <<optional>> <<optional>> 3. <<end>> Neither the name of
        <<var:12>> may be used to endorse or promote products derived from this software without specific prior written permission. <<end>> THIS SOFTWARE
        IS PROVIDED BY <<var:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, <<optional>> and/or <<end>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:8>> DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:8>> BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "gpl-grant": """is free software you can redistribute it and/or modify it under the terms of the GNU <<optional>> Lesser <<end>> <<optional>> Affero <<end>>
        General Public License as published by the Free Software Foundation, either version <<var:2>> of the License, or (at your option) any later version.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def text_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text, A-Z in lower case."""
    return text.translate(_TABLE).split()


class Automaton(NamedTuple):
    #: The mandatory words that every accepted place starts with.
    start: tuple[bytes, ...]
    #: moves[s]: (word or None for any word, next state)
    moves: tuple[tuple[tuple[bytes | None, int], ...], ...]
    #: skips[s]: states reached without a word
    skips: tuple[tuple[int, ...], ...]


def markup(template: str) -> list[str]:
    """Regions and words of a template; words as those of texts, so that templates can be written as published."""
    parts = re.findall(r"<<optional>>|<<end>>|<<var:\d+>>|[^\s<>]+", template)
    return [x for part in parts for x in ([part] if part.startswith("<<") else map(bytes.decode, text_words(part.encode())))]


def compile_template(template: str) -> Automaton:
    moves, skips, start, opened, leading = [[]], [[]], [], [], True

    def state() -> int:
        moves.append([])
        skips.append([])
        return len(moves) - 1

    for part in markup(template):
        here = len(moves) - 1
        if part == "<<optional>>":
            opened.append(here)
            leading = False
        elif part == "<<end>>":
            skips[opened.pop()].append(here)
        elif part.startswith("<<var:"):
            leading = False
            states = [here] + [state() for _ in range(int(part[6:-2]))]
            for a, b in zip(states, states[1:]):
                moves[a].append((None, b))
                skips[a].append(states[-1])
        else:
            word = part.encode()
            moves[here].append((word, state()))
            if leading:
                start.append(word)
    if not start:
        raise ValueError("a template starts with a mandatory word")
    return Automaton(tuple(start), tuple(map(tuple, moves)), tuple(map(tuple, skips)))


def _closure(automaton: Automaton, states: set[int]) -> set[int]:
    todo = list(states)
    while todo:
        for t in automaton.skips[todo.pop()]:
            if t not in states:
                states.add(t)
                todo.append(t)
    return states


def accepted_length(automaton: Automaton, words: list[bytes], at: int) -> int:
    """Words of the longest accepted walk from ``at``, 0 if there is none."""
    states, final, best = _closure(automaton, {0}), len(automaton.moves) - 1, 0
    for i in range(at, len(words)):
        states = _closure(automaton, {t for s in states for w, t in automaton.moves[s] if w is None or w == words[i]})
        if not states:
            break
        if final in states:
            best = i - at + 1
    return best


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase's words stand consecutively; ``joined``: the words, each between two spaces."""
    found, at, word, seen = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``, no shuffle: n_words, n_base (places of phrases), first_word and
    last_word (their smallest and largest start; else null), base_labels, labels (with those of
    accepted templates), score (share of the text's words inside phrases and accepted places),
    places (array of label, start, length).

    Null text: as empty, score 0, no labels.  Null ids stay null, repeated rows stay repeated, an
    empty table gives an empty table, other columns are ignored.  Places may overlap; all count.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,length:long>>"

    def make():
        automata = [(label, compile_template(t)) for label, t in templates.items()]
        wanted = [(label, p.encode(), p.count(" ") + 1) for p, label in phrases.items()]

        def one(text: bytes) -> tuple:
            words = text_words(text)
            joined = b" " + b" ".join(words) + b" "
            base = [(label, i, n) for label, p, n in wanted for i in places(joined, p)] if words else []
            more = [(label, i, n) for label, a in automata for i in places(joined, b" ".join(a.start)) if (n := accepted_length(a, words, i))] if words else []
            starts = [i for _, i, _ in base]
            covered = {j for _, i, n in base + more for j in range(i, i + n)}
            own, every = sorted({x[0] for x in base}), sorted({x[0] for x in base + more})
            return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(every), len(covered) / len(words) if words else 0.0, [{"label": label, "start": i, "length": n} for label, i, n in sorted(base + more)])

        return lambda ids, texts: [ids, *map(list, zip(*map(one, texts)))]

    return map_texts(id_and_text(docs, id_col, text_col), schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("places")


def pattern_of(template: str) -> tuple[str, str, int]:
    """First word, regular expression over words that each have a space behind them, and most words of a place."""
    parts, out, most = markup(template), "", 0
    for part in parts:
        if part.startswith("<<var:"):
            out, most = out + f"(?:[^ ]+ ){{0,{part[6:-2]}}}", most + int(part[6:-2])
        else:
            out += {"<<optional>>": "(?:", "<<end>>": ")?"}.get(part, f"{part} ")
            most += not part.startswith("<<")
    return parts[0], "^" + out, most


_RULES = ",\n  ".join(f"('{label}', {base}, '{first}', '{pattern}', {most})" for base, rules in (("true", [(v, k) for k, v in PHRASES.items()]), ("false", TEMPLATES.items())) for label, text in rules for first, pattern, most in [pattern_of(text)])

ORACLE_SQL = rf"""
WITH rules(label, base, first, pattern, most) AS (VALUES
  {_RULES}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
starts AS (
  SELECT r, label, base, i, regexp_extract(array_to_string(ws[i : i + most - 1], ' ') || ' ', pattern) AS found
  FROM words JOIN rules ON w = first JOIN texts USING (r)),
places AS (SELECT r, label, base, i - 1 AS i, length(found) - length(replace(found, ' ', '')) AS n FROM starts WHERE found <> ''),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + n)) AS j FROM places) x GROUP BY r),
listed AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(i) FILTER (WHERE base) AS first_word, max(i) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE n::DOUBLE / len(ws) END AS score
FROM texts LEFT JOIN listed USING (r) LEFT JOIN covered USING (r)
"""
