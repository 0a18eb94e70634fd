"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, which are normalised: letters lower-cased (A-Z), everything
but letters, digits, dots and plus signs made a space, dots at the ends dropped. Sentences
that are known are mapped to identifiers; all others are a gap. The resulting sequence is
matched against the rules in their order: a rule is a run of identifiers without a gap, and
what one rule has taken is not seen by the next, so a licence's long form comes before its
short one. Nothing is shuffled.

List markers (numbers and letters, with a dot or in brackets) are no gap and are dropped before
known sentences. A holder's name in the third clause of BSD-3 is read as `the copyright holder`.
A line `SPDX-License-Identifier:` is a sentence, known if its expression names a licence of the
rules, and gives each that it names (MIT OR Apache-2.0 gives both); other names give nothing.
The SQL of oracle_sql has the sentences and rules only in common with this. It is written from the
definition by lines, with its own cuts: it knows list markers, but neither holders' names nor SPDX.

Defined results: null, empty and sentence-free texts have no licence ('' and 0); a licence
found many times is named once, at its first place; known sentences that complete no rule
count in n_sentences only; repeated rows each get their result; an empty table gives no rows; a result
column takes the place of a kept column of the same name; texts of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of licence notices, by identifier.
SENTENCES: list[tuple[str, str]] = [
    ("mit-ref", "Released under the MIT License."),
    ("mit-ref", "Licensed under the MIT License."),
    ("mit-ref", "This project is licensed under the MIT License."),
    ("mit-ref", "This software is released under the MIT License."),
    ("mit-ref", "Distributed under the MIT License."),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("no-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache2-ref", "Licensed under the Apache License, Version 2.0."),
    ("apache2-ref", "Released under the Apache License, Version 2.0."),
    ("apache2-ref", "This project is licensed under the Apache License 2.0."),
    ("apache2-ref", "Licensed under the Apache License 2.0."),
    ("apache2-grant", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl2-ref", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl2-ref", "Licensed under the GNU General Public License, version 2."),
    ("gpl2-ref", "Licensed under the GNU General Public License v2.0."),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-ref", "Licensed under the GNU General Public License, version 3."),
    ("gpl3-ref", "Licensed under the GNU General Public License v3.0."),
    ("gpl2-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl-useful", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("gpl-received", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl21-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl21-ref", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl3-ref", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl3-ref", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd2-ref", "Licensed under the BSD 2-Clause License."),
    ("bsd3-ref", "Licensed under the BSD 3-Clause License."),
    ("mpl2-grant", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2-ref", "Licensed under the Mozilla Public License, Version 2.0."),
    ("isc-ref", "Licensed under the ISC License."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-ref", "Licensed under CC0 1.0."),
    ("cc-by-ref", "Licensed under CC BY 4.0."),
    ("cc-by-sa-ref", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-ref", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa-ref", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd-ref", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-nd-ref", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

# The rules in their order, a licence's longer forms first.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-permission", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-permission", "mit-notice"]),
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache2-grant", "apache2-copy", "apache2-as-is", "apache2-see"]),
    ("Apache-2.0", ["apache2-grant", "apache2-obtain", "apache2-url", "apache2-as-is", "apache2-see"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-useful", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-useful", "gpl-see", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-useful", "gpl-see"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-2.1-only", ["lgpl21-ref"]),
    ("LGPL-3.0-only", ["lgpl3-ref"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("MPL-2.0", ["mpl2-grant"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-ref"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-ref"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-ref"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-ref"]),
]

# More sentences; the dot of "v. 2.0" ends one, and a blank line stands before the address.
MORE: list[tuple[str, str]] = [
    ("apache2-obtain", "You may obtain a copy of the License at"),
    ("apache2-url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-url", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("mpl2-grant", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
]
# SPDX names of before version 3 of its list.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAD = r"[ \t*#/;>%-]*"
_OPENINGS = "Licensed|Released|Distributed|Copyright|Permission|Redistribution|This |SPDX|The above|THE SOFTWARE|IN NO EVENT|Neither|Unless|You |See the"
#: (pattern, replacement) pairs that turn a text into normalised sentences between marks; $1 is the first group.
_GAP = "[^A-Za-z0-9\x01]+"
#: Steps before those below: a holder's name in the third BSD clause, and the lines of SPDX.
FIRST: list[tuple[str, str]] = [
    (f"(?is)\\bneither{_GAP}the{_GAP}names?{_GAP}of{_GAP}(?:(?!\\bneither\\b)[^\x01]){{1,200}}?{_GAP}nor{_GAP}the{_GAP}names{_GAP}of{_GAP}(?:(?:its|their|his|her|the|any|other){_GAP}){{1,2}}contributors\\b", "Neither the name of the copyright holder nor the names of its contributors"),
    (r"(?i)(SPDX-License-Identifier[ \t]*:[^\r\n\x01]*)", "\x01$1\x01"),
]
STEPS: list[tuple[str, str]] = [
    (r"\r\n?", "\n"),
    (r"\n" + _LEAD + r"\n", "\x01"),
    (r"\n" + _LEAD + "(" + _OPENINGS + ")", "\x01$1"),
    (r"([.!?])[\"')]*[ \t\n]+", "$1\x01"),
    (r"(conditions are met|following conditions):[ \t\n]*", "$1\x01"),
]
CLEAN: list[tuple[str, str]] = [
    ("[^a-z0-9.+\x01]+", " "),
    ("[. \x01]*\x01[. \x01]*", "\x01"),
    (r"^[. ]+", ""),
    (r"[. ]+$", ""),
]


#: A normalised list marker, and how a normalised line of SPDX begins.
_MARKER = "(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})\\.?"
_SPDX = "spdx license identifier "


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9.+]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(". ")


def _known() -> dict[str, str]:
    return {normalised(s): name for name, s in SENTENCES}


def licences(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_sentences (known ones), n_licenses and licenses (names, joined by commas) of each row."""
    known = _known() | {normalised(s): name for name, s in MORE}
    labels = list(dict.fromkeys(name for name, _ in RULES))
    ids = {name: i for i, name in enumerate(dict.fromkeys([*known.values(), *[f"spdx-{x}" for x in labels]]))}
    spdx = {normalised(x): f"<{ids[f'spdx-{y}']}>" for x, y in [*zip(labels, labels), *SPDX_OLD.items()]}
    t: Column = F.coalesce(F.col(text), F.lit(""))
    for pattern, to in FIRST + STEPS:
        t = F.regexp_replace(t, pattern, to)
    t = F.translate(t, UPPER, LOWER)
    for pattern, to in CLEAN:
        t = F.regexp_replace(t, pattern, to)
    names = F.create_map(*[F.lit(x) for s, n in known.items() for x in (s, f"<{ids[n]}>")])
    spdx_names = F.create_map(*[F.lit(x) for pair in spdx.items() for x in pair])
    named = r"(?:^| or | and )(" + "|".join(re.escape(x).replace(r"\ ", " ") for x in sorted(spdx, key=len, reverse=True)) + ")(?=$| or | and | with )"

    def token(s: Column) -> Column:
        bare = F.regexp_replace(s, f"^{_MARKER} ", "")
        expression = F.regexp_extract_all(F.substring(s, len(_SPDX) + 1, 1 << 20), F.lit(named), F.lit(1))
        return (
            F.when(s.isin(list(known)), F.element_at(names, s))
            .when(s.rlike(f"^{_MARKER}$"), F.lit(""))
            .when(s.startswith(_SPDX), F.coalesce(F.nullif(F.array_join(F.transform(expression, lambda x: F.element_at(spdx_names, x)), ""), F.lit("")), F.lit("-")))
            .when(s.rlike(f"^{_MARKER} ") & bare.isin(list(known)), F.element_at(names, bare))
            .otherwise(F.lit("-"))
        )

    tokens = F.transform(F.split(t, "\x01"), token)
    sequence: Column = F.array_join(F.col("__tokens"), "")
    for name, rule in [*RULES, *[(x, [f"spdx-{x}"]) for x in labels]]:
        sequence = F.replace(sequence, F.lit("".join(f"<{ids[x]}>" for x in rule)), F.lit(f"[{labels.index(name)}]"))
    found = F.array_distinct(F.regexp_extract_all(F.col("__sequence"), F.lit(r"\[(\d+)\]"), F.lit(1)))
    naming = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (str(i), name)])
    made = ("n_sentences", "n_licenses", "licenses")
    keep = tuple(c for c in keep if c not in made)
    out = docs.select(*keep, tokens.alias("__tokens"))
    out = out.select(*keep, F.size(F.filter("__tokens", lambda x: ~x.isin("-", ""))).cast("long").alias("n_sentences"), sequence.alias("__sequence"))
    out = out.select(*keep, "n_sentences", found.alias("__found"))
    return out.select(*keep, "n_sentences", F.size("__found").cast("long").alias("n_licenses"), F.array_join(F.transform("__found", lambda x: F.element_at(naming, x)), ",").alias("licenses"))


def oracle_sql() -> str:
    """The same in DuckDB SQL, by lines: cuts come where a line is blank, where a line begins as notices do, after
    the signs that end sentences, and after the colon of conditions; a sentence is its words, in lower case."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known: dict[str, str] = {}
    for name, sentence in [*SENTENCES, *MORE]:
        bare = re.sub("[^a-z0-9.+ ]", " ", sentence.lower())
        known[" ".join(bare.split()).strip(". ")] = name
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known.items())
    labels = list(dict.fromkeys(name for name, _ in RULES))
    sequence = "ids"
    for name, rule in RULES:  # in their order: what one has taken is gone for the next
        sequence = f"replace({sequence}, {quote(''.join(f'<{x}>' for x in rule))}, {quote(f'[{labels.index(name)}]')})"
    naming = "map {" + ", ".join(f"'{i}': {quote(name)}" for i, name in enumerate(labels)) + "}"
    return f"""
WITH known(sentence, id) AS (
  VALUES {rows}
), cut AS (
  SELECT doc_id, string_split_regex(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents
), body AS (
  SELECT doc_id, row_number() OVER () AS n, array_to_string(list_transform(l, lambda x, i: CASE
    WHEN i > 1 AND i < len(l) AND regexp_full_match(x, '[ \\t*#/;>%-]*') THEN chr(1)
    WHEN i > 1 AND regexp_matches(x, '^[ \\t*#/;>%-]*({_OPENINGS})') THEN chr(1) || x
    ELSE x END), chr(10)) AS t FROM cut
), colon AS (
  SELECT doc_id, n, array_to_string(list_transform(string_split(t, ':'), lambda x, i: CASE WHEN regexp_matches(x, '(conditions are met|following conditions)$') THEN x || chr(1) ELSE x || ' ' END), '') AS b FROM body
), piece AS (
  SELECT doc_id, n, unnest(string_split_regex(b, chr(1) || '|[.!?]["'')]*[ \\t' || chr(10) || ']+')) AS raw, generate_subscripts(string_split_regex(b, chr(1) || '|[.!?]["'')]*[ \\t' || chr(10) || ']+'), 1) AS i FROM colon
), plain AS (
  SELECT doc_id, n, i, trim(regexp_replace(translate(raw, '{UPPER}', '{LOWER}'), '[^a-z0-9.+]+', ' ', 'g'), '. ') AS s FROM piece
), short AS (
  SELECT doc_id, n, i, s, regexp_replace(s, '^(?:[0-9]{{1,3}}|[a-z]|[ivx]{{1,4}})\\.? ', '') AS bare FROM plain WHERE s <> ''
), seen AS (
  SELECT doc_id, n, i, CASE WHEN regexp_full_match(s, '(?:[0-9]{{1,3}}|[a-z]|[ivx]{{1,4}})\\.?') AND k.id IS NULL THEN '' WHEN coalesce(k.id, m.id) IS NULL THEN '-' ELSE '<' || coalesce(k.id, m.id) || '>' END AS token
  FROM short LEFT JOIN known k ON k.sentence = s LEFT JOIN known m ON m.sentence = bare
), told AS (
  SELECT doc_id, n, string_agg(token, '' ORDER BY i) AS ids, count(*) FILTER (token LIKE '<%') AS n_sentences FROM seen GROUP BY doc_id, n
), named AS (
  SELECT body.doc_id, coalesce(n_sentences, 0) AS n_sentences, regexp_extract_all(coalesce({sequence}, ''), '\\[(\\d+)\\]', 1) AS found
  FROM body LEFT JOIN told USING (n)
), once AS (
  SELECT doc_id, n_sentences, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM named
)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(found) AS BIGINT) AS n_licenses, coalesce(array_to_string(list_transform(found, lambda x: {naming}[x]), ','), '') AS licenses FROM once
"""
