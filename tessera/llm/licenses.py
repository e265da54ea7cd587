"""Licence scans: lines, paragraphs and whole texts against licence templates by Dice over word bigrams.

DataFrame functions only. A unit's number of distinct bigrams bounds its Dice coefficient with a
template (2 min / (a + b)), so only templates of fitting size are compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

THRESHOLD = 0.8
# Notices and texts by which licences are named or granted.
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "This work is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        GRANT + " " + AS_IS,
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", BSD.format(third="")],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.",
        BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ISC],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Licensed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, Version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0."],
    "all-rights-reserved": ["All rights reserved."],
}


def bigrams_of(text: str) -> list[str]:
    """The distinct bigrams of a template, in order."""
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit that holds a licence: doc_id, unit, position, license, dice.

    Units are the lines of a whole text, its paragraphs (runs of lines between blank ones, if they
    have several lines) and the text itself if it has several paragraphs; positions count from 0
    among the units of a kind. Letters are lower-cased and all but a-z and 0-9 separates words. A
    unit gets the licence of its best template, the first by name where several are as good. Null,
    empty and one-word units hold none; rows with a null id are scanned like others; repeated rows
    give rows each; an empty table gives an empty result. Other texts than those of TEMPLATES, such
    as the whole GPL, are found with ``templates`` that hold them.
    """
    known = [(name, g) for name, texts in (TEMPLATES if templates is None else templates).items() for g in map(bigrams_of, texts) if g]
    sizes = [len(g) for _, g in known]
    most = int(max(sizes, default=0) * (2 - threshold) / threshold)
    every = sorted({x for _, g in known for x in g})
    text = F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "[^a-z0-9\\n]+", " ")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))

    def unit(kind: str, i: Column, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), i.alias("position"), x.alias("raw"))

    paragraphs = F.split("t", "\\n(?: *\\n)+")
    several = F.filter(F.transform(paragraphs, lambda x, i: unit("paragraph", i, x)), lambda u: F.contains(F.trim(F.regexp_replace(u["raw"], "^[ \\n]+|[ \\n]+$", "")), F.lit("\n")))
    units = F.concat(
        F.transform(F.split("t", "\\n"), lambda x, i: unit("line", i, x)),
        several,
        F.when(F.size(paragraphs) > 1, F.array(unit("text", F.lit(0), F.col("t")))).otherwise(F.array().cast("array<struct<unit:string,position:int,raw:string>>")),
    )
    rows = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.position", F.filter(F.split("u.raw", "[ \\n]+"), lambda w: w != "").alias("words"))
    # What must hold of the words alone: d distinct words make d - 1 distinct bigrams or more, and
    # of a unit's bigrams threshold / (2 - threshold) are a template's, each of which begins with one of its words.
    vocabulary = sorted({w for g in every for w in g.split(" ")})
    least = F.size(F.array_distinct("words")) - 1
    inside = F.size(F.filter("words", lambda w: w.isin(vocabulary)))
    rows = rows.where(F.size("words") >= 2).where(least <= most).where((2 - threshold) * inside >= threshold * least - 1e-6)
    rows = rows.select("doc_id", "unit", "position", _bigrams(F.col("words")).alias("grams"))
    rows = rows.where(F.size("grams") <= most).where(F.exists("grams", lambda g: g.isin(every)))
    # the index: for each number of bigrams the templates that the size bound admits
    fitting: dict[int, list[tuple[str, list[str]]]] = {}
    for name, g in known:
        for m in range(1, most + 1):
            if 2 * min(m, len(g)) >= threshold * (m + len(g)):
                fitting.setdefault(m, []).append((name, g))
    index = docs.sparkSession.createDataFrame(list(fitting.items()), "m int, templates array<struct<license:string,grams:array<string>>>")
    met = rows.join(F.broadcast(index), F.size("grams") == F.col("m"))

    def dice(t: Column) -> Column:
        return F.round(2.0 * F.size(F.array_intersect("grams", t["grams"])) / (F.col("m") + F.size(t["grams"])), 6)

    # the highest coefficient, then the first name: the least of (-dice, license)
    best = F.array_min(F.transform("templates", lambda t: F.struct((-dice(t)).alias("d"), t["license"].alias("license"))))
    out = met.select("doc_id", "unit", "position", best.alias("best")).where(F.col("best.d") <= -threshold)
    return out.select("doc_id", "unit", F.col("position").cast("long").alias("position"), F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"))


def op2_dice_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    values = ", ".join(f"('{name}', [{', '.join(repr(x) for x in g)}])" for name, texts in TEMPLATES.items() for g in map(bigrams_of, texts))
    return rf"""
WITH d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_split_to_array(t, '\n(?: *\n)+') AS ps FROM d),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(ls))) AS position, unnest(ls) AS raw FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d)
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(ps))), unnest(ps) AS raw FROM p) WHERE contains(regexp_replace(regexp_replace(raw, '^[ \n]+', ''), '[ \n]+$', ''), chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, t FROM p WHERE len(ps) > 1),
w AS (SELECT doc_id, unit, position, list_filter(regexp_split_to_array(raw, '[ \n]+'), lambda x: x <> '') AS words FROM u),
g AS (SELECT doc_id, unit, position, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) >= 2),
t(license, template) AS (VALUES {values}),
s AS (SELECT doc_id, unit, position, license, round(2.0 * len(list_intersect(grams, template)) / (len(grams) + len(template)), 6)::DOUBLE AS dice
  FROM g JOIN t ON 2 * least(len(grams), len(template)) >= 0.8 * (len(grams) + len(template)))
SELECT doc_id, unit, position, license, dice FROM s WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY dice DESC, license) = 1
"""


SQL = _sql()
