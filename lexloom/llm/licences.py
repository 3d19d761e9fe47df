"""Licence scans: lines and whole texts against licence templates by Dice coefficient.

Texts are normalised (A-Z lower-cased, everything but letters a-z and digits one space).  A unit (each
line, and the whole text where it has several) is compared by its set of word bigrams.  A unit with too
few or too many bigrams for a template cannot reach the threshold t, as Dice >= t needs
|T| * t / (2 - t) <= |U| <= |T| * (2 - t) / t: those templates are skipped before any set is compared.
The same bound says that a match shares |T| / (2 - t) * t bigrams or more, so it holds one of any words that
leave fewer bigrams than that untouched: units without any of these telling words are not split at all.

What no unit matches is searched for notices inside lines or wrapped over several: runs of words of each
template's size, matched lines apart.  A best run begins and ends with bigrams of the template, and is only
looked at where enough of these stand close together (within twice the most bigrams of a match, as some may
be repeated).  Each template found so counts as one unit.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; on equal scores
the licence whose name sorts first wins; repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, with_row

#: Least Dice coefficient of a match.
LEAST = 0.8
#: Stands for a matched line, and in no template.
MATCHED = "0matched0"
# Public licence notices and short licence texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "http://www.boost.org/LICENSE_1_0.txt)",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
        "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
)


def bigrams(text: str) -> list[str]:
    """The set of word bigrams of a normalised template, sorted."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates() -> list[tuple[str, list[str]]]:
    return sorted((name, bigrams(text)) for name, text in TEMPLATES)


def bounds(size: int, least: float = LEAST) -> tuple[int, int]:
    """The least and most bigrams of a unit that can match a template with ``size`` of them."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def telling_words(least: float = LEAST) -> list[str]:
    """Few long words such that every unit that matches some template holds one of them."""
    grams = [(i, g.split()) for i, (_, own) in enumerate(templates()) for g in own]
    sizes = [len(own) for _, own in templates()]
    words = sorted({w for _, g in grams for w in g})
    held = {w: {k for k, (_, g) in enumerate(grams) if any(w in x for x in g)} for w in words}
    untouched = set(range(len(grams)))
    out: list[str] = []
    while True:
        left = [0] * len(sizes)
        for k in untouched:
            left[grams[k][0]] += 1
        todo = {i for i, n in enumerate(left) if n >= sizes[i] * least / (2 - least) - 1e-9}
        if not todo:
            return out
        open_ = {k for k in untouched if grams[k][0] in todo}
        gain = {w: len(held[w] & open_) for w in words}
        out.append(max((w for w in words if gain[w]), key=lambda w: (len(w) >= 6, gain[w], len(w), w)))
        untouched -= held[out[-1]]


def _hashed(grams: list[str]) -> Column:
    return F.array(*[F.xxhash64(F.lit(g)) for g in grams])


def _best(grams: Column, least: float) -> Column:
    """struct<score, name> of the best template of a unit's bigram set; null where none reaches ``least``."""
    found = []
    for name, own in templates():
        low, high = bounds(len(own), least)
        score = 2.0 * F.size(F.array_intersect(grams, _hashed(own))) / (F.size(grams) + len(own))
        fits = F.size(grams).between(low, high)
        found.append(
            F.when(fits, F.when(score >= least, F.struct((-score).alias("neg"), F.lit(name).alias("name"))))
        )
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))


def _run(grams: Column, own: list[str], least: float) -> Column:
    """The best score of a run of a text's bigrams (in order) against one template; null where none can reach ``least``."""
    (low, high), keys = bounds(len(own), least), _hashed(own)
    places = F.transform(grams, lambda g, i: F.when(F.array_contains(keys, g), i + 1))

    def scored(a: Column, b: Column) -> Column:
        run = F.array_distinct(F.slice(grams, a, b - a + 1))
        return 2.0 * F.size(F.array_intersect(run, keys)) / (F.size(run) + len(own))

    def best(at: Column) -> Column:
        starts = F.filter(at, lambda a, i: F.get(at, i + (low - 1)) - a < 2 * high)
        return F.array_max(F.transform(starts, lambda a: F.array_max(F.transform(F.filter(at, lambda b: (b > a) & (b - a < 2 * high)), lambda b: scored(a, b)))))

    # The transform of one element binds the places, so that they are not made again for every start.
    score = F.get(F.transform(F.array(F.filter(places, lambda i: i.isNotNull())), best), 0)
    return F.when(F.size(F.array_intersect(grams, keys)) >= low, score)


def _runs(grams: Column, least: float) -> Column:
    """array<struct<neg, name>>: the best run for each template that has one."""
    scores = F.array(*[F.struct((-_run(grams, own, least)).alias("neg"), F.lit(name).alias("name")) for name, own in templates()])
    return F.filter(scores, lambda x: x["neg"] <= -least)


def scan(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with license, license_score and license_units: the best match and how many units match.

    Units are distinct as normalised: a line that differs from another in its marks alone is the same one.
    """
    sizes = [len(own) for _, own in templates()]
    fewest, most = bounds(min(sizes), least)[0], bounds(max(sizes), least)[1]
    telling = telling_words(least)

    def tells(x: Column) -> Column:
        return reduce(lambda a, b: a | b, [x.contains(w) for w in telling])

    plain = with_row(docs, text_col)
    plain = plain.withColumn(
        "__plain",  # A-Z alone change their case, as nothing else is left
        F.when(tells(F.lower("__text")), F.lower(F.regexp_replace("__text", r"[^A-Za-z0-9\n]+", " "))).otherwise(F.lit("")),
    )
    text = F.col("__plain")
    lines = F.filter(F.split(text, "\n", -1), tells)
    units = F.when(text.contains("\n"), F.concat(lines, F.array(text))).otherwise(lines)

    def in_order(unit: Column) -> Column:
        words = F.filter(F.split(unit, "[^a-z0-9]+"), lambda w: w != "")
        return F.when(
            F.size(words) > 1,
            F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b))),
        ).otherwise(F.array().cast("array<bigint>"))

    def grams(unit: Column) -> Column:
        return F.array_distinct(in_order(unit))

    sets = F.transform(F.array_distinct(units), lambda u: F.struct(u.alias("u"), grams(u).alias("g")))
    out = plain.withColumn("__sets", F.filter(sets, lambda x: F.size(x["g"]).between(fewest, most)))
    hits = F.transform("__sets", lambda x: F.struct(x["u"].alias("u"), _best(x["g"], least).alias("x")))
    out = out.withColumn("__hits", F.filter(hits, lambda x: x["x"].isNotNull()))
    matched = F.transform("__hits", lambda x: x["u"])
    # A matched line becomes a word of no template, a matched text leaves nothing to search.
    rest = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(F.array_contains(matched, x), MATCHED).otherwise(x)), " ")
    rest = F.when(F.array_contains(matched, text), "").otherwise(rest)
    out = out.withColumn("__order", F.when(tells(rest), in_order(rest)).otherwise(F.array().cast("array<bigint>")))
    runs = F.when(F.size("__order") > 0, _runs(F.col("__order"), least)).otherwise(F.array().cast("array<struct<neg: double, name: string>>"))
    out = out.withColumn("__found", F.concat(F.transform("__hits", lambda x: x["x"]), runs))
    best = F.array_min("__found")
    return added(
        out, docs, license=best["name"], license_score=F.round(-best["neg"], 6), license_units=F.size("__found").cast("bigint")
    )


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "license", "license_score", "license_units")


def sql() -> str:
    """The same result in DuckDB SQL."""
    rows = ", ".join(f"({i}, '{n}', {[*g]!r})" for i, (n, g) in enumerate(templates()))
    return f"""
WITH template(tid, name, grams) AS (VALUES {rows}),
unit AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), [t]))) AS u
         FROM (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents)),
word AS (SELECT doc_id, u, list_filter(regexp_split_to_array(u, '[^a-z0-9]+'), lambda w: w <> '') AS w FROM unit),
gram AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM word WHERE len(w) > 1),
hit AS (SELECT doc_id, u, name, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS score
        FROM gram JOIN template ON len(g) BETWEEN len(grams) * {LEAST} / {2 - LEAST} - 1e-9 AND len(grams) * {2 - LEAST} / {LEAST} + 1e-9),
best AS (SELECT doc_id, u, max(score) AS score, min_by(name, struct_pack(a := -score, b := name)) AS name FROM hit WHERE score >= {LEAST} GROUP BY ALL),
doc AS (SELECT doc_id, min_by(name, struct_pack(a := -score, b := name)) AS name, max(score) AS score, count(*) AS n FROM best GROUP BY doc_id)
SELECT d.doc_id, name AS license, round(score, 6) AS license_score, coalesce(n, 0) AS license_units
FROM documents d LEFT JOIN doc USING (doc_id)"""
