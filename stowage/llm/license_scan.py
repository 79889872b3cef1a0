"""Licence scan with DataFrame functions only: units of normalised text against templates by the Dice coefficient of word bigrams.

Units are lines, the whole text, and for each template the runs of as many words as it has that begin with its first two words, so that
a notice is found when it is wrapped over lines or stands inside a longer paragraph.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Licence notices and whole short licences in common use, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def signal_words(grams: list[str], threshold: float) -> set[str]:
    """Words of which any matching unit has one: a match holds at least threshold / (2 - threshold) of the template's bigrams, and more
    of the bigrams than it may miss hold one of these words. The longest words come first, as they are the rarest."""
    need, words, covered = len(grams) * (1 - threshold / (2 - threshold)) + 1e-9, set(), 0
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
        if covered > need:
            break
        words.add(word)
        covered = sum(bool(words & set(g.split())) for g in grams)
    return words


def _bigrams(w: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def _words(piece: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(piece, " +", " ")), " ")


def _units(low: Column, whole: Column) -> Column:
    """Bigrams of each line and of the whole text, where there are any."""
    lines = F.filter(F.transform(F.split(low, "\n"), _words), lambda w: F.size(w) > 1)
    return F.array_distinct(F.transform(F.concat(lines, F.filter(F.array(whole), lambda w: F.size(w) > 1)), _bigrams))


def _windows(whole: Column, words: list[str]) -> Column:
    """Bigrams of the runs of as many words as the template has that begin with its first two."""
    at = F.filter(F.sequence(F.lit(1), F.size(whole) - 1), lambda i: (F.element_at(whole, i) == words[0]) & (F.element_at(whole, i + 1) == words[1]))
    return F.transform(at, lambda i: _bigrams(F.slice(whole, i, F.lit(len(words)))))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, license_id (null: none), dice (0: none), n_licenses (ids that match).

    A unit is a line, the whole text, or a run of words as long as the template that begins with its first two words; all lower-cased, as
    words of a-z and 0-9. It matches a template whose Dice coefficient over distinct word bigrams is at least threshold; a template is
    compared only with units whose number of bigrams is within threshold / (2 - threshold) of its own, either way. The best match gives
    license_id, ties to the smaller id. Null, empty and one-word texts match nothing; repeated rows keep a row each; extra columns are
    ignored.
    """
    ratio = threshold / (2 - threshold)
    known = [(name, g, words_of(text)) for name, text in templates if (g := bigrams(text))]
    signal = sorted(set().union(*(signal_words(g, threshold) for _, g, _ in known)))
    text = F.col(text_col).cast("string")
    maybe = F.lower(text).rlike(r"(?<![a-z0-9])(?:" + "|".join(signal) + r")(?![a-z0-9])")
    low = F.when(maybe, F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("low")).withColumn("whole", _words(F.regexp_replace("low", "\n", " ")))
    rows = rows.withColumn("units", _units(F.col("low"), F.col("whole"))).withColumn("joined", F.concat(F.lit(" "), F.array_join("whole", " "), F.lit(" ")))

    def best(grams: list[str], words: list[str]) -> Column:
        m, own = len(grams), F.array(*map(F.lit, grams))
        units = F.when(F.col("joined").contains(f" {words[0]} {words[1]} "), F.concat("units", _windows(F.col("whole"), words))).otherwise(F.col("units"))
        near = F.filter(units, lambda u: (F.size(u) >= ratio * m - 1e-9) & (F.size(u) <= m / ratio + 1e-9))
        return F.array_max(F.transform(near, lambda u: 2.0 * F.size(F.array_intersect(u, own)) / (F.size(u) + F.lit(m))))

    scores = F.array(*(F.struct(F.lit(name).alias("id"), best(grams, words).alias("dice")) for name, grams, words in known))
    rows = rows.select("doc_id", F.when(F.size("units") > 0, F.filter(scores, lambda s: s["dice"] >= threshold)).alias("hits"))
    top = F.element_at(F.array_sort(F.transform("hits", lambda s: F.struct((-s["dice"]).alias("order"), s["id"].alias("id"), s["dice"].alias("dice")))), 1)
    return rows.select("doc_id", F.when(F.size("hits") > 0, top).alias("top"), F.coalesce(F.size(F.array_distinct(F.transform("hits", lambda s: s["id"]))), F.lit(0)).alias("n")).select("doc_id", F.col("top.id").alias("license_id"), F.coalesce("top.dice", F.lit(0.0)).alias("dice"), F.greatest("n", F.lit(0)).cast("long").alias("n_licenses"))


def duckdb_sql() -> str:
    """The same scan as DuckDB SQL over the whole documents table, with TEMPLATES and THRESHOLD."""
    values = ", ".join("('{}', {}, {})".format(name, [*bigrams(text)], [*words_of(text)]) for name, text in TEMPLATES)
    return f"""
WITH t(id, grams, tw) AS (VALUES {values}),
text AS (SELECT row_number() OVER () AS row, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS low FROM documents),
whole AS (SELECT row, trim(regexp_replace(replace(low, chr(10), ' '), ' +', ' ', 'g')) AS s FROM text),
piece AS (SELECT row, unnest(list_distinct(list_append(list_transform(string_split(low, chr(10)), lambda p: trim(regexp_replace(p, ' +', ' ', 'g'))), trim(regexp_replace(replace(low, chr(10), ' '), ' +', ' ', 'g'))))) AS p FROM text),
words AS (SELECT row, string_split(p, ' ') AS w FROM piece),
unit AS (SELECT row, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS u FROM words WHERE len(w) > 1),
opens AS (SELECT row, t.id, t.grams, t.tw, string_split(s, ' ') AS w FROM whole JOIN t ON contains(' ' || s || ' ', ' ' || tw[1] || ' ' || tw[2] || ' ')),
starts AS (SELECT row, id, grams, tw, w, unnest(list_filter(range(1, len(w)), lambda i: w[i] = tw[1] AND w[i + 1] = tw[2])) AS pos FROM opens),
run AS (SELECT row, id, grams, w[pos:pos + len(tw) - 1] AS w FROM starts),
window_unit AS (SELECT row, id, grams, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS u FROM run),
hit AS (
  SELECT row, id, 2.0::DOUBLE * len(list_intersect(u, grams)) / (len(u) + len(grams)) AS dice
  FROM unit JOIN t ON len(u) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(grams) - 1e-9 AND len(grams) / {THRESHOLD / (2 - THRESHOLD)} + 1e-9
  UNION ALL SELECT row, id, 2.0::DOUBLE * len(list_intersect(u, grams)) / (len(u) + len(grams)) FROM window_unit
  WHERE len(u) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(grams) - 1e-9 AND len(grams) / {THRESHOLD / (2 - THRESHOLD)} + 1e-9),
best AS (SELECT row, id, max(dice) AS dice FROM hit WHERE dice >= {THRESHOLD} GROUP BY row, id),
top AS (SELECT row, arg_min(id, struct_pack(o := -dice, i := id)) AS license_id, max(dice) AS dice, count(*) AS n FROM best GROUP BY row)
SELECT d.doc_id, license_id, coalesce(dice, 0.0::DOUBLE) AS dice, coalesce(n, 0)::BIGINT AS n_licenses
FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) d LEFT JOIN top USING (row)"""
