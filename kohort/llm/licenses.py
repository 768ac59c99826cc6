"""Licence scan: passages of the normalised text against templates by Dice coefficient over word bigrams. Native."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


# Public licence texts and notices. Longer ones (whole GPL or Apache texts) go in by the parameter.
TEMPLATES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0-header", _gnu("GNU Affero General Public License", "3")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
        ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
        " See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-2-clause-text", _BSD_HEAD + _BSD_TAIL),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause-text", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    (
        "bsl-1.0-text",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
        " The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0-header", _gnu("GNU General Public License", "2")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", _gnu("GNU General Public License", "3")),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("lgpl-3.0-header", _gnu("GNU Lesser General Public License", "3")),
    ("mit", "Released under the MIT License."),
    (
        "mit-grant",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    (
        "mit-text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
        " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
        " We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
        " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
        " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
)

THRESHOLD = 0.8


def normalise(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 (line ends too) a space, no space at the ends, one spelling."""
    flat = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.regexp_replace(flat, "licen[cs]e", "license")


def _bigrams(words: Column) -> Column:
    """64-bit hashes of neighbouring words."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.slice(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(last, F.lit(1))), lambda a, b: F.xxhash64(a, b)), F.lit(1), last)


def _words(df: DataFrame, *keep: str) -> DataFrame:
    """keep, ``_n`` (words) and ``_g`` (bigrams) of the text column."""
    df = df.select(*keep, F.split(normalise(F.coalesce(F.col("text"), F.lit(""))), " ").alias("_w"))
    return df.select(*keep, F.when(F.get("_w", F.lit(0)) != "", F.size("_w")).otherwise(0).alias("_n"), _bigrams(F.col("_w")).alias("_g"))


def least_common(size: int, threshold: float) -> int:
    """Bigrams that a passage must share at least with a template of that size: 2c >= threshold (n + size), and n >= c."""
    return next(c for c in range(1, size + 1) if 2.0 * c / (c + size) >= threshold)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, matches`` for each row of docs; matches: ``id, score, word`` of each template that a passage matches.

    A template with s bigrams of words is compared with every passage of the whole normalised text, whatever its lines: the
    s bigrams from a word on, or as many as are left. A passage matches when Dice, 2 * common / (passage + s) over bags of
    bigrams (by 64-bit hashes), is at least threshold. score is the greatest, word the first place (from 0) of such a
    passage among those that begin with a bigram of the template: any other begins before one that is no worse. matches are
    in order of id, empty if there are none. Null, empty and one-word texts match nothing; a repeated doc_id gives a row
    for each row; templates of fewer than two words raise. No rows give no rows.

    Pruning, all lossless: a passage shares at least ``least_common`` bigrams, so a text that has too few of all templates'
    bigrams is done; so is a template of which the text has too few; and a passage is only compared if the bigram that many
    hits after its first is still inside it. Bags need no counting: a hit counts in a passage unless as many equal ones as
    the template has stand before it there. Plan: no shuffle; everything stays in its row.
    """
    spark = docs.sparkSession
    made = _words(spark.createDataFrame(list(templates), "id string, text string"), "id").collect()  # the templates only
    if bad := [r.id for r in made if not r["_g"]]:
        raise ValueError(f"templates of fewer than two words: {bad}")
    known = []
    for r in sorted(made, key=lambda r: r.id):
        bag: dict[int, int] = {}
        for g in r["_g"]:
            bag[g] = bag.get(g, 0) + 1
        size = len(r["_g"])
        need = least_common(size, threshold)
        known.append({"id": r.id, "s": size, "need": need, "some": need - (size - len(bag)), "g": list(bag), "c": list(bag.values())})
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  one literal after folding
    every = literal(sorted({g for t in known for g in t["g"]}), "array<bigint>")
    table = literal(known, "array<struct<id:string,s:int,need:int,some:int,g:array<bigint>,c:array<int>>>")
    fewest = min((t["some"] for t in known), default=1)

    def compared(t: Column, g: Column) -> Column:
        """The best passage for a template, null if none reaches the threshold."""
        n, s = F.size(g), t["s"]
        # Hits: place, bigram, and how often the template has it.
        found = F.transform(g, lambda x, i: F.struct(i.alias("at"), x.alias("g"), F.get(t["c"], F.array_position(t["g"], x).cast("int") - 1).alias("c")))
        found = F.filter(found, lambda h: h["c"].isNotNull())

        def scored(hits: Column) -> Column:
            at = lambda j: F.get(hits, j)["at"]
            least = lambda j: F.ceil(F.lit(threshold) * (F.least(s, n - at(j)) + s) / 2 - 1e-9).cast("int")
            starts = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda j: F.coalesce(at(j + least(j) - 1) < at(j) + s, F.lit(False)))
            # before: the place of the equal hit that is c of them earlier, -1 if there is none within s hits.
            before = lambda h, i: F.coalesce(F.try_element_at(F.filter(F.slice(hits, F.greatest(i - s, F.lit(0)) + 1, F.least(i, s)), lambda o: o["g"] == h["g"]), -h["c"])["at"], F.lit(-1))
            judged = F.transform(hits, lambda h, i: F.struct(h["at"].alias("at"), F.when(i > 0, before(h, i)).otherwise(-1).alias("before")))

            def score(j: Column, own: Column) -> Column:
                here = F.size(F.filter(F.slice(own, j + 1, s), lambda h: (h["at"] < at(j) + s) & (h["before"] < at(j))))
                return F.lit(2.0) * here / (F.least(s, n - at(j)) + s)

            # An array of one, so that what is computed once is named by a lambda.
            best = F.transform(F.array(judged), lambda own: F.array_max(F.transform(starts, lambda j: F.struct(score(j, own).alias("score"), (-at(j)).alias("word")))))
            return F.when(F.size(hits) >= t["need"], F.get(best, F.lit(0)))

        return F.get(F.transform(F.array(found), scored), F.lit(0))

    def matches(g: Column, common: Column) -> Column:
        near = F.filter(table, lambda t: (F.size(g) >= t["need"]) & (F.size(F.array_intersect(common, t["g"])) >= t["some"]))
        all_ = F.transform(near, lambda t: F.struct(t["id"].alias("id"), compared(t, g).alias("x")))
        return F.transform(F.filter(all_, lambda m: m["x"]["score"] >= threshold), lambda m: F.struct(m["id"].alias("id"), m["x"]["score"].alias("score"), (-m["x"]["word"]).alias("word")))

    flat = _words(docs, "doc_id")
    flat = flat.select("doc_id", "_n", "_g", F.array_intersect("_g", every).alias("_c"))
    none = F.array().cast("array<struct<id:string,score:double,word:int>>")
    return flat.select("doc_id", F.col("_n").cast("long").alias("n_words"), F.when(F.size("_c") >= fewest, matches(F.col("_g"), F.col("_c"))).otherwise(none).alias("matches"))


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(name, text)`` of the files of a folder, the name being the file's without its ending."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("id"), "value").collect()  # the templates only
    return sorted((r.id, r.value) for r in rows)


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, without any of the pruning but that a passage begins with a bigram of the template."""
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in templates)
    norm = "regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), 'licen[cs]e', 'license', 'g')"
    return f"""
WITH t(id, txt) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split({norm.format("coalesce(text, '')")}, ' ') AS w FROM documents),
tg AS (SELECT id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT id, string_split({norm.format('txt')}, ' ') AS w FROM t), unnest(range(1, len(w))) AS u(i)),
tb AS (SELECT id, g, count(*) AS c FROM tg GROUP BY 1, 2), ts AS (SELECT id, count(*) AS s FROM tg GROUP BY 1),
dg AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS g, len(w) - 1 AS n FROM docs, unnest(range(1, len(w))) AS u(i)),
h AS (SELECT r, id, i, g, c, n, s FROM dg JOIN tb USING (g) JOIN ts USING (id)),
p AS (SELECT a.r, a.id, a.i, a.n, a.s, b.g, least(count(*), max(b.c)) AS c FROM h a JOIN h b ON b.r = a.r AND b.id = a.id AND b.i >= a.i AND b.i < a.i + a.s GROUP BY 1, 2, 3, 4, 5, 6),
d AS (SELECT r, id, max(score) AS score FROM (SELECT r, id, i, 2.0 * sum(c) / (least(s, n - i + 1) + s) AS score FROM p GROUP BY r, id, i, n, s) GROUP BY 1, 2 HAVING max(score) >= {threshold}),
a AS (SELECT r, count(*) AS n_matched, string_agg(id, ',' ORDER BY id) AS licenses, max(score) AS best_score FROM d GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN w[1] = '' THEN 0 ELSE len(w) END AS BIGINT) AS n_words, CAST(coalesce(n_matched, 0) AS BIGINT) AS n_matched, coalesce(licenses, '') AS licenses, CAST(round(coalesce(best_score, 0), 6) AS DOUBLE) AS best_score
FROM docs LEFT JOIN a USING (r)
"""
