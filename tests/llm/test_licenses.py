import re

from pyspark.sql import functions as F

from wayhex.llm import licenses, queries

from .common import awkward, frame
from .duck import compare


def test_query_against_sql(spark, sf):
    got = compare(queries.op6_license_scan(spark, sf), queries.ORACLE_SQL["op6_license_scan"], sf)
    assert any(r.licenses for r in got)


def test_every_license_line_is_found(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_license_scan(spark, sf).collect()}
    for doc, text in docs.items():
        for line, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"), ("the GNU General Public License, version 3.", "GPL-3.0")):
            if any(x.endswith(line) for x in text.split("\n")):
                assert name in got[doc].licenses.split(","), (doc, line)
    assert sum(bool(r.licenses) for r in got.values()) < len(docs) / 2


def text_of(*ids):
    by = {i: s for s, i in reversed(licenses.KNOWN.items())}
    return "\n".join(by[i].capitalize() + "." if i else "Something else." for i in ids)


def test_rules_are_ordered(spark):
    cases = {
        text_of(16, 17, 18, 19): "BSD-3-Clause", text_of(16, 17, 18): "BSD-2-Clause", text_of(16, 18): "", text_of(1, 2, 3): "Apache-2.0", text_of(6, 7, 8, 0, 1): "MIT,Apache-2.0",
        text_of(5, 0, 5): "MIT,MIT", text_of(6): "", text_of(10, 12): "GPL-3.0-or-later", "we use the MIT License.": "",
        "LICENSED  under the\napache license,\nversion 2.0!": "Apache-2.0", "Licensed under the Apache License, Version 2.05.": "",
    }
    out = licenses.scan(frame(spark, list(enumerate(cases)))).orderBy("doc_id").collect()
    assert [r.licenses for r in out] == list(cases.values())
    assert [r.n_loose for r in out][:4] == [0, 0, 2, 0]
    assert all(len(re.findall("<", str(k))) == 0 for k in licenses.KNOWN)


def test_awkward_rows(spark):
    out = licenses.scan(frame(spark, awkward()).withColumnRenamed("lang", "_s").withColumnRenamed("source", "licenses")).collect()
    assert len(out) == len(awkward()) and all(r.licenses == "" and r.n_known == 0 for r in out)
    assert {r.doc_id: r.n_sentences for r in out}[1] == 0
    assert licenses.scan(frame(spark, [])).collect() == []


GPL = """{a}This program is free software: you can redistribute it and/or modify
{b}it under the terms of the GNU General Public License as published by
{b}the Free Software Foundation, either version 3 of the License, or
{b}(at your option) any later version.
{c}
{b}This program is distributed in the hope that it will be useful,
{b}but WITHOUT ANY WARRANTY; without even the implied warranty of
{b}MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{b}GNU General Public License for more details.
{c}
{b}You should have received a copy of the GNU General Public License
{b}along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """{a}Licensed under the Apache License, Version 2.0 (the "License");
{b}you may not use this file except in compliance with the License.
{b}You may obtain a copy of the License at
{c}
{b}    http://www.apache.org/licenses/LICENSE-2.0
{c}
{b}Unless required by applicable law or agreed to in writing, software
{b}distributed under the License is distributed on an "AS IS" BASIS,
{b}WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
{b}See the License for the specific language governing permissions and
{b}limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Somebody

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
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""


def test_published_notices_in_their_usual_shapes(spark):
    shapes = [{"a": "", "b": "", "c": ""}, {"a": "/* ", "b": " * ", "c": " *"}, {"a": "// ", "b": "// ", "c": "//"}, {"a": "# ", "b": "# ", "c": "#"}]
    cases = [(text.format(**s) + "\nint main() {}\n", name) for text, name in ((GPL, "GPL-3.0-or-later"), (APACHE, "Apache-2.0")) for s in shapes]
    lesser = GPL.replace("program", "library").replace("General Public", "Lesser General Public")
    cases += [(GPL.format(a="", b="", c="").replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2"), "GPL-2.0-or-later")]
    cases += [(lesser.format(a="", b="", c=""), "LGPL-3.0-or-later"), (GPL.format(a="", b="", c="").replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU\nAffero General"), "AGPL-3.0-or-later")]
    cases += [(MIT, "MIT"), (BSD.format(third=THIRD), "BSD-3-Clause"), (BSD.format(third=""), "BSD-2-Clause"), (ISC, "ISC"), (MPL, "MPL-2.0"), (UNLICENSE, "Unlicense"), (MIT + "\n" + ISC, "MIT,ISC")]
    out = licenses.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)])).orderBy("doc_id").collect()
    assert [r.licenses for r in out] == [name for _, name in cases]
    assert all(r.n_loose == 0 for r in out)


def test_sentences_in_python_and_in_spark(spark):
    texts = [GPL.format(a="/* ", b=" * ", c=" *"), MIT, BSD.format(third=THIRD), "A title without an end\nReleased under the MIT License.\n", "", "one; two. three"]
    got = frame(spark, list(enumerate(texts))).select("doc_id", licenses.sentences(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in got] == [licenses.sentences_of(t) for t in texts]


def test_a_catalogue_of_the_users_own(spark):
    rows = [(1, "X-1", 0, "You may use this.", False), (1, "X-1", 1, "But not on Sundays.", True), (2, "Y", 0, "Do as you please!", False)]
    own = licenses.Catalogue.from_tables(spark.createDataFrame(rows, "rule long, licence string, place long, sentence string, optional boolean"))
    texts = ["You may use this. But not on Sundays.", "you may use this", "But not on Sundays.", "Do as you please! You may use this.", "Released under the MIT License."]
    out = licenses.scan(frame(spark, list(enumerate(texts))), catalogue=own).orderBy("doc_id").collect()
    assert [(r.licenses, r.n_loose) for r in out] == [("X-1", 0), ("X-1", 0), ("", 1), ("Y,X-1", 0), ("", 0)]
