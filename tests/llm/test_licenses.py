import re
import textwrap

import duckdb
import pytest

from reelmetrics.llm import licenses
from reelmetrics.llm.licenses import RULES, SENTENCES, SLOTTED


def plain(text):
    """The same by plain code."""
    forms = [re.sub("[^A-Za-z0-9]+", " ", p).lower().strip() for p in re.sub(r"([.!?])[ \t\f\r\v]+", "\\1\n", text or "").split("\n")]
    names = [SENTENCES[f] for f in forms if f in SENTENCES]
    unknown = sum(f not in SENTENCES and any(h in f for h in licenses.HINTS) for f in forms)
    left, found, n = list(names), [], 0
    for name, run in RULES:
        run, i = run.split(), 0
        while i + len(run) <= len(left):
            if left[i : i + len(run)] == run:
                left[i : i + len(run)] = ["*"]
                n += 1
                if name not in found:
                    found.append(name)
            i += 1
    return names, found, n, sum(x != "*" for x in left), unknown


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
TEXTS = [
    None,
    "",
    "no such line. at all",
    "Text.\nReleased under the MIT License.\nMore. Licensed under the Apache License, Version 2.0.  Licensed under CC BY-NC 4.0.",
    MIT,
    MIT + "\n# Licensed under the MIT license!\nSome other licensing terms.",
    "Released under the MIT License. " * 3 + "See the GNU General Public License for more details.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "word " * 200_000 + "\nReleased under the MIT License.",
    "This is free and unencumbered software released into the public domain. All rights reserved.",
]


def test_against_plain_code(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")], "doc_id long, text string, licenses string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r.sentences, r.licenses, r.n_matches, r.n_unmatched, r.n_unknown) == plain(TEXTS[r.doc_id or 0])
    assert plain(TEXTS[4])[1] == ["MIT"] and plain(TEXTS[8])[1] == ["GPL-3.0-or-later"]
    assert licenses.scan(docs.where("false")).count() == 0


@pytest.mark.parametrize("sentence", SENTENCES)
def test_sentences_are_in_normal_form_and_probed(sentence):
    assert re.sub("[^A-Za-z0-9]+", " ", sentence).lower().strip() == sentence
    assert re.search(licenses._PROBE, sentence)


def test_rules_name_known_sentences():
    assert {n for _, run in RULES for n in run.split()} <= {*SENTENCES.values(), *SLOTTED.values()}


MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
FREE = "This is free and unencumbered software released into the public domain."
MIT_RUN, BSD_RUN = "MitGrant MitNotice MitAsIs MitLiable", "BsdGrant BsdSource BsdBinary"
APACHE_RUN = "Apache2Name Apache2Comply Apache2Copy Apache2AsIs Apache2See"
NOTICES = [
    (MIT.partition("The above")[0] + MIT_END, "MIT", f"MitTitle {MIT_RUN}"), (BSD, "BSD-2-Clause", BSD_RUN), (BSD3, "BSD-3-Clause", f"{BSD_RUN} BsdEndorse"),
    (GPL, "GPL-3.0-or-later", "Gpl3OrLater GplNoWarranty GplSee GplCopy"), (ISC, "ISC", "IscGrant"), (MPL, "MPL-2.0", "Mpl2Terms Mpl2Copy"),
    (APACHE, "Apache-2.0", APACHE_RUN), (FREE, "Unlicense", "Unlicense"),
]


BSD_END = """THIS SOFTWARE IS PROVIDED BY EXAMPLE INC. AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL EXAMPLE INC. BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
NAMED = BSD3.replace("the copyright holder", "Example Inc.")
NOTICES += [
    (NAMED, "BSD-3-Clause", f"{BSD_RUN} BsdEndorse"), (f"{NAMED}\n\n{BSD_END}", "BSD-3-Clause", f"{BSD_RUN} BsdEndorse BsdAsIs BsdLiable"),
    (f"{BSD}\n\n{BSD_END}", "BSD-2-Clause", f"{BSD_RUN} BsdAsIs BsdLiable"), (LGPL, "LGPL-2.1-or-later", "Lgpl21OrLater LgplNoWarranty LgplSee"),
    (MIT.partition("The above")[0] + MIT_END.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "SOME ONE, ANOTHER ONE"), "MIT", f"MitTitle {MIT_RUN}"),
]


def wrap(text, width, mark):
    paragraphs = [textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False) for p in text.split("\n\n")]
    return ("\n" + mark.rstrip() + "\n").join("\n".join(mark + line for line in p) for p in paragraphs)


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_notices(spark, mark):
    texts = [(19 * w + k, f"int main;\n\n{wrap(text, w, mark)}\n\nint x;") for w in (40, 72, 80, 5_000) for k, (text, _, _) in enumerate(NOTICES)]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, " ".join(r.sentences)) for r in got} == {19 * w + k: ([n], run) for w in (40, 72, 80, 5_000) for k, (_, n, run) in enumerate(NOTICES)}


def test_lines_that_are_no_wrapped_sentence(spark):
    texts = ["MIT\n\nLicense", "Released under the MIT\nLicense for users", "Not released under the MIT\nLicense", "MIT. License"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.sentences == [] for r in got)


def test_names_have_a_bound(spark):
    """A slot takes names of one to twelve words: not none, and not whole sentences of other words."""
    line = "Neither the name of{} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    names = [" Example", " the University of California, Berkeley", " a b c d e f g h i j k l", "", " a b c d e f g h i j k l m"]
    got = licenses.scan(spark.createDataFrame([(i, line.format(n)) for i, n in enumerate(names)], "doc_id long, text string")).collect()
    assert [r.sentences for r in sorted(got, key=lambda r: r.doc_id)] == [["BsdEndorse"]] * 3 + [[]] * 2


def test_sql_finds_the_same(spark):
    """The SQL check agrees on sentences that stand each in a line of its own, those with names included."""
    lines = [*SENTENCES, *(s.replace("*", "some one else") for s in SLOTTED), "some license of another kind"]
    texts = ["\n".join(lines[k:] + lines[:k]) for k in range(0, len(lines), 9)] + [t.replace("INC.", "INC").replace("Inc.", "Inc").replace(". ", ".\n").replace("or\n", "or ") for t, _, _ in NOTICES[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (" ".join(r.sentences), " ".join(r.licenses), *r[3:]) for r in licenses.scan(docs).collect()}
    base = duckdb.connect()
    base.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in base.sql(f"SELECT doc_id, sentences, licenses, n_matches, n_unmatched, n_unknown FROM ({licenses.check_sql()})").fetchall()}
    assert got == want
