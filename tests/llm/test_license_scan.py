import duckdb

from terrahac.llm import license_scan, queries
from tests.llm.util import same_as_sql

SF = "/root/testdata/sf0.01"
# The wording of public licences and notices, as published.
MIT = """
/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
 * LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
 * OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
 * SOFTWARE.
 */
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_against_sql(spark):
    same_as_sql(queries.op3_licenses(spark, SF), license_scan.oracle_sql(), SF)


def test_notices(spark):
    cases = {
        1: (MIT, "MIT", 4), 2: (BSD + NAMES, "BSD-3-Clause", 4), 3: (BSD, "BSD-2-Clause", 3),
        4: ("Some words.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License. Released under the MIT License.", "CC-BY-NC-4.0,MIT", 3),
        5: ("This work is licensed under the GNU General Public License, version 3. More", "GPL-3.0-only", 1),
        6: ("We like the MIT License. See the GNU General Public License for more details.", "", 1),
        7: (None, "", 0), 8: ("", "", 0), 9: ("x" * 300_000, "", 0),
        10: ("licensed under the apache license, version 2.0\x01z", "Apache-2.0", 1),
    }
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _, _) in cases.items()] + [(1, MIT, 1), (None, "", 1)], "doc_id long, text string, licenses int")
    got = license_scan.licences(docs).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.licenses, r.n_sentences) == cases[r.doc_id][1:], r
    assert license_scan.licences(docs.limit(0)).count() == 0


def test_rules_name_known_sentences():
    names = {n for n, _ in license_scan.SENTENCES + license_scan.MORE}
    assert all(set(rule) <= names for _, rule in license_scan.RULES)


# More of them.
BSD3 = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
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
DISCLAIMED.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


def test_canonical_texts_and_spdx(spark):
    two = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
    google = BSD3.replace("the name of the copyright holder", "the name of Google Inc.")
    cases = [
        (BSD3, "BSD-3-Clause", 4), (two, "BSD-2-Clause", 3), (google, "BSD-3-Clause", 4), (" ".join(google[google.index("Redistribution") :].split()), "BSD-3-Clause", 4),
        (google.replace("\n", "\r\n * "), "BSD-3-Clause", 4),
        (BSD3.replace("1.", "(a)").replace("2.", "b)").replace("3.", "(iii)"), "BSD-3-Clause", 4),
        (BSD3.replace("1.", "*").replace("2.", "*").replace("3.", "*"), "BSD-3-Clause", 4),
        (MPL, "MPL-2.0", 1),
        ("// SPDX-License-Identifier: MIT\n#include <a.h>", "MIT", 1),
        ("/* SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) */\nint x;", "GPL-2.0-or-later,MIT", 1),
        ("x\r\n# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception AND GPL-2.0+\r\ny", "Apache-2.0,GPL-2.0-or-later", 1),
        ("SPDX-License-Identifier: MIT-0", "", 0), ("SPDX-License-Identifier: BSD-3-Clause-Clear", "", 0), ("spdx-license-identifier:", "", 0),
        ("1. One\n\n2. Two", "", 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in license_scan.licences(docs).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


# Notices as their publishers tell users to write them.
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use."


def test_published_notices_in_spark_and_sql(spark):
    starred = lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */"
    cases = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (ISC, "ISC"), (UNLICENSE, "Unlicense"), (BSD3, "BSD-3-Clause"), (MPL, "MPL-2.0")]
    cases += [(starred(t), n) for t, n in cases[1:6]] + [(t.replace("\n", "\r\n"), n) for t, n in cases[:8]] + [(APACHE + "\n" + GPL3, "Apache-2.0,GPL-3.0-or-later")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = sorted(map(tuple, license_scan.licences(docs).collect()))
    assert [r[3] for r in got] == [n for _, n in cases]
    assert got[1][1] == 5 and got[2][1] == 4  # every sentence of them is known
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(license_scan.oracle_sql()).fetchall()) == got


def test_every_rule_can_fire(spark):
    """The sentences of each rule, one after the other, give its licence, whatever rules come before it."""
    said = {}
    for name, sentence in [*license_scan.MORE, *license_scan.SENTENCES]:
        said.setdefault(name, sentence)
    texts = [("\n\n".join(said[x] for x in rule), name) for name, rule in license_scan.RULES]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = sorted(map(tuple, license_scan.licences(docs).collect()))
    assert [(r[1], r[3]) for r in got] == [(len(rule), name) for name, rule in license_scan.RULES]
