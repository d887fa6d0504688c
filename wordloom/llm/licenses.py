"""Licence scans by Dice coefficient over word bigrams, with SQL functions only.

A text's units are its lines, its paragraphs (between blank lines) and the whole.
A unit is normalised (lower case; all but a-z and 0-9 is a space) and becomes the
set of its bigrams; each licence template likewise.  A unit matches a template
if ``2 * common / (unit + template)`` reaches the threshold t.

Two exact bounds spare comparisons: the sizes must be within a factor of
``t / (2 - t)``, and a match has at least that share of the template's bigrams,
so it has one of any larger remainder (the template's anchors).

The templates are notices, grants and disclaimers of some thirty licences, of
which long licences are mostly known by the notice that their text asks for.

Scale: one pass without shuffle; each document is judged by itself; the
templates are literals of the plan.

Defined results: a null or empty text has no unit and matches nothing; units or
templates of fewer than two words have no bigram and match nothing; ties go to
the licence that is first in code point order; rows are judged one by one; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.fingerprint import bound

THRESHOLD = 0.8

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Licence and text or notice, as published; a licence may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", _BSD_DISCLAIMER),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", _ISC_DISCLAIMER),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_DISCLAIMER),
    ("MIT", f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_DISCLAIMER}"),
    ("MIT", "Released under the MIT License."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ODbL-1.0", "This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the Database Contents License: http://opendatacommons.org/licenses/dbcl/1.0/"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def bigrams(unit: Column) -> Column:
    """Hashes of a normalised unit's distinct word bigrams."""

    def of(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<bigint>"))

    return bound(F.split(unit, " "), of)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def matches(spark: SparkSession, text: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """All matches of a text's units: structs of dice (negated, so that the least is best) and licence, best first."""
    rows = spark.createDataFrame([(i, name, t) for i, (name, t) in enumerate(templates)], "i int, name string, t string")
    made = rows.select("i", "name", bigrams(normalized(F.col("t"))).alias("b"), F.split(normalized(F.col("t")), " ").alias("w")).orderBy("i").collect()
    made = [r for r in made if r["b"]]
    share = threshold / (2 - threshold)
    anchors: set[int] = set()
    for r in made:
        # The longest bigrams are the rarest; any so many include one of every match.
        lengths = {}
        for h, pair in zip(spark_order(r["w"]), zip(r["w"], r["w"][1:], strict=False), strict=False):
            lengths.setdefault(h, len(pair[0]) + len(pair[1]))
        order = sorted(range(len(r["b"])), key=lambda k: (-lengths.get(k, 0), k))
        need = len(r["b"]) - int(-(-share * len(r["b"]) // 1)) + 1
        anchors.update(r["b"][k] for k in order[:need])
    least, most = share * min(len(r["b"]) for r in made), max(len(r["b"]) for r in made) / share
    marks = _longs(sorted(anchors))

    lines = F.split(text, "\n")
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    units = F.transform(F.array_distinct(F.concat(lines, paragraphs, F.array(text))), normalized)
    gaps = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    # A unit has at most one bigram per gap; many gaps with few distinct bigrams are left to the next filter.
    fit = F.filter(units, lambda u: gaps(u) >= least)
    sets = F.filter(F.transform(fit, bigrams), lambda b: (F.size(b) >= least) & (F.size(b) <= most) & F.arrays_overlap(b, marks))

    def judge(b: Column) -> Column:
        one = []
        for r in made:
            size = len(r["b"])
            common = F.size(F.array_intersect(b, _longs(list(r["b"]))))
            dice = common * 2 / (F.size(b) + size)
            close = (F.size(b) >= share * size) & (F.size(b) <= size / share)
            one.append(F.when(close, F.when(dice >= threshold, F.struct((-dice).alias("d"), F.lit(r["name"]).alias("name")))))
        return F.array(*one)

    return F.sort_array(F.filter(F.flatten(F.transform(sets, judge)), lambda m: m.isNotNull()))


def spark_order(words: list[str]) -> list[int]:
    """For each bigram of a template, in order, its place among the distinct ones."""
    seen: dict[tuple[str, str], int] = {}
    return [seen.setdefault(pair, len(seen)) for pair in zip(words, words[1:], strict=False)]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, license (the best match; null if none), dice (0 if none), licenses (all, comma-joined)."""
    found = matches(docs.sparkSession, F.coalesce("text", F.lit("")), templates, threshold)
    rows = docs.select("doc_id", found.alias("m"))
    return rows.select("doc_id", F.get("m", F.lit(0))["name"].alias("license"), F.coalesce(-F.get("m", F.lit(0))["d"], F.lit(0.0)).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.col("m.name"))), ",").alias("licenses"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, without the bounds."""
    values = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in templates)
    norm = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT name, string_split({norm.format("x")}, ' ') AS w FROM (VALUES {values}) v(name, x)),
tb AS (SELECT name, {grams} AS b FROM t),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text])) AS x FROM documents),
ub AS (SELECT doc_id, {grams} AS b FROM (SELECT doc_id, string_split({norm.format("x")}, ' ') AS w FROM u)),
m AS (SELECT doc_id, name, 2 * len(list_intersect(ub.b, tb.b))::DOUBLE / (len(ub.b) + len(tb.b)) AS d FROM ub JOIN tb ON len(ub.b) + len(tb.b) > 0
      WHERE len(list_intersect(ub.b, tb.b)) * 2 >= {threshold} * (len(ub.b) + len(tb.b))),
best AS (SELECT doc_id, first(name ORDER BY d DESC, name) AS license, max(d) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM m GROUP BY doc_id)
SELECT d.doc_id, b.license, coalesce(b.dice, 0.0) AS dice, coalesce(b.licenses, '') AS licenses FROM documents d LEFT JOIN best b USING (doc_id)
"""
