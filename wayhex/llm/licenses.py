"""Licence recognition by sentence rules.

Sentences are normalised and mapped to identifiers of known licence sentences; a
document is then a sequence of identifiers, 0 for any other sentence. Ordered
rules replace the identifiers they match by their licence: an earlier rule takes sentences away from later ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised as sentences() does.
KNOWN: dict[str, int] = {
    "licensed under the apache license version 2 0": 1,
    "you may not use this file except in compliance with the license": 2,
    "you may obtain a copy of the license at": 3,
    "you may obtain a copy of the license at http www apache org licenses license 2 0": 3,
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": 4,
    "released under the mit license": 5,
    "licensed under the mit license": 5,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 6,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 7,
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": 8,
    "this work is licensed under the gnu general public license version 3": 9,
    "licensed under the gnu general public license version 3": 9,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 10,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": 11,
    "this program is distributed in the hope that it will be useful but without any warranty": 12,
    "licensed under cc by nc 4 0": 13,
    "licensed under cc by 4 0": 14,
    "this work is licensed under a creative commons attribution 4 0 international license": 14,
    "licensed under cc by sa 4 0": 15,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 16,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 17,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": 18,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 19,
    "this source code form is subject to the terms of the mozilla public license v 2 0": 20,
    "all rights reserved": 21,
}
#: Rules in order: licence, and a pattern over identifiers. <n> is sentence n; a rule matches sentences that follow each other.
RULES: list[tuple[str, str]] = [
    ("BSD-3-Clause", "<16>(<0>)?<17>(<0>)?<18>(<0>)?<19>"),
    ("BSD-2-Clause", "<16>(<0>)?<17>(<0>)?<18>"),
    ("Apache-2.0", "<1>(<2>)?(<3>)?(<0>)?(<4>)?"),
    ("MIT", "<6><7>(<8>)?"),
    ("MIT", "<5>"),
    ("GPL-3.0-or-later", "<10>(<12>)?"),
    ("GPL-2.0-or-later", "<11>(<12>)?"),
    ("GPL-3.0", "<9>"),
    ("CC-BY-NC-4.0", "<13>"),
    ("CC-BY-SA-4.0", "<15>"),
    ("CC-BY-4.0", "<14>"),
    ("MPL-2.0", "<20>"),
    ("All-Rights-Reserved", "<21>"),
]


#: Notices as published, in the order in which they are looked for: licence, and its sentences in order; those that start with "? " may be missing.
NOTICES: list[tuple[str, list[str]]] = [
    ("BSD-3-Clause", [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        '? THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "? IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
        "? LOSS OF USE, DATA, OR PROFITS;",
        "? OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ]),
    ("BSD-2-Clause", [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        '? THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "? IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;",
        "? LOSS OF USE, DATA, OR PROFITS;",
        "? OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ]),
    ("Apache-2.0", [
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at",
        '? Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "? See the License for the specific language governing permissions and limitations under the License.",
    ]),
    ("MIT", [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        '? THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "? IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ]),
    ("ISC", [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        '? THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "? IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ]),
    *((f"{name}-{version}.0-or-later" if version != "2.1" else f"{name}-2.1-or-later", [
        f"This {kind} is free software{mark}",
        f"you can redistribute it and/or modify it under the terms of the GNU {words} as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version.",
        f"? This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
        f"? without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        f"? See the GNU {words} for more details.",
        f"? You should have received a copy of the GNU {words} along with this {kind}.",
    ]) for name, version, kind, words, mark, either in (
        ("GPL", "3", "program", "General Public License", ":", ", either"), ("GPL", "2", "program", "General Public License", ";", "; either"),
        ("AGPL", "3", "program", "Affero General Public License", ":", ", either"), ("LGPL", "3", "library", "Lesser General Public License", ":", ", either"),
        ("LGPL", "2.1", "library", "Lesser General Public License", ";", "; either"),
    )),
    ("MPL-2.0", [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "? If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ]),
    ("EPL-2.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]),
    ("CC0-1.0", [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "? This software is distributed without any warranty.",
    ]),
    ("Unlicense", [
        "This is free and unencumbered software released into the public domain.",
        "? Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ]),
    ("Zlib", [
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "? Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ]),
    ("BSL-1.0", [
        "Distributed under the Boost Software License, Version 1.0.",
    ]),
]

#: What sentences() does, in order: comment signs that begin a line go; wrapped lines are joined, which end in a comma or a small letter before a small one, a bracket or a quote,
#: in a comma or a capital before a capital, or in a word that no sentence ends in; sentences part at line feeds and at . ! ? ; : before white space.
STEPS: list[tuple[str, str]] = [
    (r"(^|\n)[ \t]*(?:/\*+|\*+/|\*|//+|#+|--|;+|%+|dnl|REM)[ \t]+", "$1"),
    (r"([a-z,])\n *([a-z(\"'])", "$1 $2"),
    (r"([A-Z,]\"?)\n *([A-Z(\"'])", "$1 $2"),
    (r"( (?:the|a|an|of|and|or|under|by|to|in|with|for|this|that|any|from|on|is|at|as|Public))\n *", "$1 "),
    (r"[.!?;:]+(\s|$)", "\n"),
]


def sentences(text: Column) -> Column:
    """The normalised sentences of a text: lower-case ASCII words and numbers with single blanks, without empty ones. See STEPS."""
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    plain = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


def sentences_of(text: str) -> list[str]:
    """sentences() of one text."""
    for pattern, by in STEPS:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    return [s for part in text.split("\n") if (s := re.sub("[^a-z0-9]+", " ", part.lower()).strip(" "))]


MOST_SENTENCES = 10_000


@dataclass(frozen=True)
class Catalogue:
    """Known sentences, normalised, with their identifiers, and rules in order: (licence, pattern over identifiers). It goes out with the plan, so it is bounded by MOST_SENTENCES."""

    sentences: dict[str, int]
    rules: list[tuple[str, str]]

    @staticmethod
    def of(sentences: dict[str, int], rules: list[tuple[str, str]], notices: list[tuple[str, list[str]]]) -> Catalogue:
        """Sentences and rules given outright, after those that follow from notices. Between a notice's sentences one unknown sentence may stand, such as a number or an address."""
        known, made = dict(sentences), []
        gap = "(?:<0>)?"
        for name, texts in notices:
            pattern = ""
            for k, text in enumerate(texts):
                ids = "".join(f"<{known.setdefault(s, max(known.values(), default=0) + 1)}>" for s in sentences_of(text.removeprefix("? ")))
                between = gap if k else ""
                pattern += f"(?:{between}{ids})?" if text.startswith("? ") else between + ids
            made.append((name, pattern))
        if len(known) > MOST_SENTENCES:
            raise ValueError(f"a catalogue of over {MOST_SENTENCES} sentences")
        return Catalogue(known, [*made, *rules])

    @staticmethod
    def from_tables(notices: DataFrame) -> Catalogue:
        """A catalogue of the user's own: rows (rule long, licence, place long, sentence, optional boolean); rules are tried in their order."""
        found: dict[int, tuple[str, list[str]]] = {}
        for r in notices.select("rule", "licence", "place", "sentence", "optional").orderBy("rule", "place").limit(MOST_SENTENCES + 1).collect():
            found.setdefault(r["rule"], (r["licence"], []))[1].append(("? " if r["optional"] else "") + r["sentence"])
        return Catalogue.of({}, [], list(found.values()))


CATALOGUE = Catalogue.of(KNOWN, RULES, NOTICES)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """(doc_id, n_sentences, n_known, licenses, n_loose) for each row.

    ``licenses`` names the matched rules in the order of the text, joined by "," ("" if none); ``n_loose`` counts
    known sentences that no rule takes. A null or empty text has no sentences. Repeated rows give repeated rows, an empty table an empty
    result. Only the id and the text are read, so other columns may have any names. A text may be as long as an array of its sentences can be.
    """
    ids = F.create_map(*[x for s, i in catalogue.sentences.items() for x in (F.lit(s), F.lit(f"<{i}>"))])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sentences(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_s"))
    rows = rows.select("doc_id", F.transform("_s", lambda s: F.coalesce(F.element_at(ids, s), F.lit("<0>"))).alias("_i"))
    known = F.size(F.filter("_i", lambda i: i != "<0>"))
    rows = rows.select("doc_id", F.size("_i").alias("n_sentences"), known.alias("n_known"), F.array_join("_i", "").alias("_q"))
    taken: Column = F.col("_q")
    for name, pattern in catalogue.rules:
        taken = F.regexp_replace(taken, pattern, "{" + name + "}")
    rows = rows.withColumn("_q", F.when(F.col("n_known") > 0, taken).otherwise(F.lit("")))
    names = F.filter(F.split(F.regexp_replace(F.regexp_replace("_q", "<[0-9]+>", ""), "[{}]+", ","), ","), lambda x: x != "")
    loose = F.size(F.split(F.regexp_replace("_q", "<0>", ""), "<")) - 1
    return rows.select("doc_id", "n_sentences", "n_known", F.array_join(names, ",").alias("licenses"), loose.alias("n_loose"))


def oracle_sql() -> str:
    """scan() of documents for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN '{s}' THEN '<{i}>'" for s, i in CATALOGUE.sentences.items())
    taken, text = "q", "coalesce(text, '')"
    for name, pattern in CATALOGUE.rules:
        taken = f"regexp_replace({taken}, '{pattern}', '{{{name}}}', 'g')"
    for pattern, by in STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, " + ("chr(10)" if by == "\n" else quote(by.replace("$", "\\"))) + ", 'g')"
    return rf"""
WITH split AS (
  SELECT doc_id, list_filter(list_transform(string_split({text}, chr(10)),
    lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS s FROM documents),
ids AS (SELECT doc_id, list_transform(s, lambda x: CASE x {cases} ELSE '<0>' END) AS i FROM split),
seq AS (SELECT doc_id, len(i) AS n_sentences, len(list_filter(i, lambda x: x <> '<0>')) AS n_known, coalesce(array_to_string(i, ''), '') AS q FROM ids),
taken AS (SELECT doc_id, n_sentences, n_known, CASE WHEN n_known > 0 THEN {taken} ELSE '' END AS q FROM seq)
SELECT doc_id, CAST(n_sentences AS INTEGER) AS n_sentences, CAST(n_known AS INTEGER) AS n_known,
  array_to_string(list_filter(string_split(regexp_replace(regexp_replace(q, '<[0-9]+>', '', 'g'), '[{{}}]+', ',', 'g'), ','), lambda x: x <> ''), ',') AS licenses,
  CAST(len(string_split(replace(q, '<0>', ''), '<')) - 1 AS INTEGER) AS n_loose
FROM taken"""
