"""Licence scans: Dice coefficient of word bigrams between normalised text and licence templates.

Text is lower-cased and everything but a-z and 0-9 separates words. A unit's distinct word bigrams A are compared with a template's
T by 2|A & T| / (|A| + |T|). Units of a text are the whole of it (unit 0), its lines (from 1), and for each template windows of as
many words as it has, which begin where a run of its bigrams begins, whatever the lines; a window counts for the line that it begins
in, unless it begins within a window that shares more bigrams with its template. So a licence wrapped into comments, in several paragraphs, or within a longer line is found in a file of any length.

A Dice of t needs t / (2 - t) <= |A| / |T| <= (2 - t) / t, so a template is left out for texts that are too small for it, and for
lines by either bound; and |A & T| >= t / (2 - t) |T|, so it is left out for texts that share less than that with it. Before that,
texts without any of the words that a match must have are left out. Of the templates that match a unit the one that shares the most
bigrams is reported, ties to the higher Dice, then to the smaller name.

Everything is built-in column functions on the row itself: no shuffle, no Python.

Edge cases: null and one-word texts have no bigrams and match nothing; repeated rows give repeated results; an empty table gives no
rows; of windows that begin in one line the best counts. Other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Licence texts, notices and headers.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit-header": "Licensed under the MIT License.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def telling_words(known: dict[str, list[str]], share: float) -> list[str]:
    """Words of which every unit that matches any template has one at least.

    A match shares ``share`` or more of the template's bigrams, so it cannot do without all bigrams that hold such words once the
    others are fewer. Words of seven letters or more that hold the most of the bigrams left are taken first, shorter ones only where
    these do not suffice; words taken for one template serve the others.
    """
    chosen: list[str] = []
    for pairs in sorted(known.values(), key=len):
        left = [set(p.split()) for p in pairs if not set(p.split()) & set(chosen)]
        while len(left) >= share * len(pairs):
            words = {w for p in left for w in p}
            chosen.append(min(words, key=lambda w: (len(w) < 7, -sum(w in p for p in left), -len(w), w)))
            left = [p for p in left if chosen[-1] not in p]
    return chosen


def _pairs(words: Column) -> Column:
    """The bigrams of an array of words, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def _constant(value: object, kind: str) -> Column:
    """A constant of any type; folded into one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, which are worked out once a row, however often later expressions use them."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns, *[c.alias(name) for name, c in columns.items()]))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, license_id, dice, n_bigrams of each unit that matches a template."""
    texts = {name: text for name, text in sorted((templates or TEMPLATES).items()) if bigrams(text)}
    known = {name: bigrams(text) for name, text in texts.items()}
    share = threshold / (2 - threshold)
    least = min(map(len, known.values())) * share
    every = _constant(sorted({p for pairs in known.values() for p in pairs}), "array<string>")
    listed = _constant([{"name": name, "n": len(pairs), "span": len(re.findall(r"[a-z0-9]+", texts[name].lower())) - 1, "pairs": pairs} for name, pairs in known.items()], "array<struct<name: string, n: int, span: int, pairs: array<string>>>")
    low = F.lower(F.col("text").cast("string"))
    some = F.lit(False)
    for word in telling_words(known, share):
        some = some | F.col("low").contains(word)
    lines = F.split(F.regexp_replace("low", "[^a-z0-9\n]+", " "), "\n")
    rows = _fixed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low")).where(some).select("doc_id", lines.alias("lines")))
    rows = _fixed(rows, pairs=_pairs(_words(F.array_join("lines", " "))))
    # What the text shares with all templates together, and the templates that it shares enough with.
    rows = _fixed(rows, shared=F.array_intersect(every, F.col("pairs"))).where(F.size("shared") >= least)
    rows = _fixed(rows, fits=F.filter(listed, lambda t: F.size(F.array_intersect(t["pairs"], F.col("shared"))) >= t["n"] * share)).where(F.size("fits") > 0)
    by_line = F.transform("lines", lambda line: F.array_distinct(_pairs(_words(line))))
    line_of = F.flatten(F.transform("lines", lambda line, i: F.transform(_words(line), lambda _: i + 1)))
    rows = _fixed(rows, line_pairs=by_line, line_of=line_of, own=F.array_distinct("pairs"))

    def compared(unit: Column, at: Column, own: Column, t: Column) -> Column:
        """A candidate; ``own`` are distinct bigrams, ``at`` a window's first word."""
        both = F.size(F.array_intersect(own, t["pairs"]))
        return F.struct(unit.cast("long").alias("unit"), (-both).alias("fewer"), (-2.0 * both / (F.size(own) + t["n"])).alias("other"), t["name"].alias("name"), F.size(own).cast("long").alias("n"), at.alias("at"), (at + t["span"]).alias("end"))

    def fitting(own: Column, t: Column) -> Column:
        return (F.size(own) >= t["n"] * share) & (F.size(own) * share <= t["n"])

    def candidates(t: Column) -> Column:
        whole = F.filter(F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"), F.col("own"))), lambda x: fitting(x["own"], t))
        by_line = F.filter(F.transform("line_pairs", lambda own, i: F.struct((i + 1).alias("i"), F.lit(None).cast("int").alias("at"), own.alias("own"))), lambda x: fitting(x["own"], t))
        hit = F.transform("pairs", lambda p: F.array_contains(t["pairs"], p))
        # Bound by a lambda, so that it is worked out once.
        places = F.transform(F.array(hit), lambda h: F.transform(h, lambda x, i: F.when(x & ((i == 0) | ~F.get(h, i - 1)), i)))
        begins = F.filter(F.flatten(places), lambda i: i.isNotNull())
        windows = F.transform(begins, lambda i: F.struct(F.get("line_of", i).alias("i"), i.alias("at"), F.array_distinct(F.slice("pairs", i + 1, t["span"])).alias("own")))
        return F.transform(F.concat(whole, by_line, windows), lambda x: compared(x["i"], x["at"], x["own"], t))

    rows = _fixed(rows, met=F.filter(F.flatten(F.transform("fits", candidates)), lambda c: -c["other"] >= threshold)).where(F.size("met") > 0).select("doc_id", "met")
    rows = _fixed(rows, found=F.expr("filter(met, c -> c.at is null or not exists(met, o -> o.at <= c.at and c.at < o.end and o.fewer < c.fewer))"))
    units = F.array_distinct(F.transform("found", lambda c: c["unit"]))
    best = rows.select("doc_id", "found", F.explode(units).alias("unit")).select("doc_id", F.array_min(F.expr("filter(found, c -> c.unit = unit)")).alias("best"))
    return best.select("doc_id", "best.unit", F.col("best.name").alias("license_id"), F.round(-F.col("best.other"), 6).alias("dice"), F.col("best.n").alias("n_bigrams"))


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB."""
    rows = ", ".join(f"('{name}', '{p}')" for name, text in TEMPLATES.items() for p in bigrams(text))
    spans = ", ".join(f"('{name}', {len(re.findall(r'[a-z0-9]+', text.lower())) - 1})" for name, text in TEMPLATES.items())
    return f"""
WITH tp(name, pair) AS (VALUES {rows}),
spans(name, span) AS (VALUES {spans}),
sizes AS (SELECT name, count(*) AS size, any_value(span) AS span FROM tp JOIN spans USING (name) GROUP BY name),
norm AS (SELECT row_number() OVER () AS id, doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
line AS (SELECT id, doc_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM norm),
listed AS (SELECT id, doc_id, line, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM line),
placed AS (SELECT id, doc_id, line, unnest(range(len(w))) AS i, unnest(w) AS w FROM listed),
words AS (SELECT id, doc_id, line, w, row_number() OVER (PARTITION BY id ORDER BY line, i) AS pos FROM placed),
pairs AS (SELECT * FROM (SELECT id, doc_id, line, pos, w || ' ' || lead(w) OVER t AS pair, lead(line) OVER t AS line2 FROM words WINDOW t AS (PARTITION BY id ORDER BY pos)) WHERE pair IS NOT NULL),
hits AS (SELECT id, pos, name FROM pairs JOIN tp USING (pair)),
enough AS (SELECT id, name FROM (SELECT DISTINCT id, name, pair FROM pairs JOIN tp USING (pair)) JOIN sizes USING (name) GROUP BY id, name, size HAVING count(*) >= size * {threshold / (2 - threshold)}),
heads AS (SELECT h.id, h.name, h.pos FROM hits h SEMI JOIN enough USING (id, name) ANTI JOIN hits g ON g.id = h.id AND g.name = h.name AND g.pos = h.pos - 1),
units AS (
  SELECT DISTINCT id, doc_id, 0 AS unit, 0 AS head, '' AS sole, pair FROM pairs
  UNION ALL SELECT DISTINCT id, doc_id, line, 0, '', pair FROM pairs WHERE line = line2
  UNION ALL SELECT DISTINCT h.id, p.doc_id, b.line, h.pos, h.name, p.pair FROM heads h JOIN sizes USING (name) JOIN pairs p ON p.id = h.id AND p.pos >= h.pos AND p.pos < h.pos + span JOIN pairs b ON b.id = h.id AND b.pos = h.pos),
counts AS (SELECT id, unit, head, sole, count(*) AS k FROM units GROUP BY ALL),
met AS (SELECT id, any_value(doc_id) AS doc_id, unit, head, sole, name, count(*) AS shared FROM units JOIN tp USING (pair) WHERE sole IN ('', name) GROUP BY id, unit, head, sole, name),
dice AS (SELECT id, doc_id, unit, head, head + span AS stop, name, k, shared, 2.0 * shared / (k + size) AS dice FROM met JOIN counts USING (id, unit, head, sole) JOIN sizes USING (name)),
fine AS (SELECT * FROM dice WHERE dice >= {threshold}),
best AS (SELECT *, row_number() OVER (PARTITION BY id, unit ORDER BY shared DESC, dice DESC, name, k) AS r FROM fine c
  WHERE NOT EXISTS (SELECT 1 FROM fine o WHERE o.id = c.id AND o.head > 0 AND c.head > 0 AND o.head <= c.head AND c.head < o.stop AND o.shared > c.shared))
SELECT doc_id, CAST(unit AS BIGINT) AS unit, name AS license_id, round(CAST(dice AS DOUBLE), 6) AS dice, k AS n_bigrams FROM best WHERE r = 1
"""
