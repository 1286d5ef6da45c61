"""License scans, natively: normalised text against licence templates by the Dice coefficient over word bigrams.

A template is compared with the whole text and with every passage of its own length, so a statement is found however it is
wrapped, indented or surrounded. Size bounds prune: with Dice 2x / (a + b) and x at most the smaller size, a template needs
t / (2 - t) of its bigrams in the text, and a whole text at most (2 - t) / t times its bigrams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements, notices and full texts of common licences, normalised when used.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
THRESHOLD = 0.8


def template_bigrams(template: str) -> list[str]:
    """Bigrams in order; templates are ASCII."""
    words = re.findall("[a-z0-9]+", template.lower())
    return words if len(words) == 1 else [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def words_needed(grams: list[str], share: float) -> int:
    """Distinct words that a text with this share of the distinct bigrams holds at least: each bigram needs both of its words."""
    uses = Counter(w for x in set(grams) for w in x.split())
    wanted, n = share * sum(uses.values()) - 1e-9, 0
    for n, most in enumerate(accumulate(sorted(uses.values(), reverse=True)), 1):
        if most >= wanted:
            break
    return n


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bigrams(words: Column) -> Column:
    """Bigrams in order, repeats included; one word counts as itself."""
    pairs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.when(F.size(words) == 1, words).otherwise(pairs)


def dice(a: Column, b: Column) -> Column:
    """Of two arrays of distinct bigrams."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id, licence, scope, dice, start_word): the templates that the text or a passage of it matches.

    Scope `document` compares the whole text; scope `passage` takes the best of all windows of as many bigrams as the
    template has that start with one of its bigrams (ties: the first), start_word being its first word. A row per document,
    licence and scope whose Dice coefficient reaches the threshold. Null, empty and punctuation-only texts have no
    findings; very long texts are compared whole; repeated rows report each; extra columns are not carried along.
    """
    share = threshold / (2 - threshold)
    known = {k: template_bigrams(t) for k, t in templates.items()}
    words = {k: sorted({w for x in g for w in x.split()}) for k, g in known.items()}
    table = F.array(*[F.struct(F.lit(k).alias("licence"), F.array(*map(F.lit, dict.fromkeys(g))).alias("grams"), F.lit(len(g)).alias("length"), F.array(*map(F.lit, words[k])).alias("words"), F.lit(words_needed(g, share)).alias("needed")) for k, g in known.items()])
    vocabulary = F.array(*map(F.lit, sorted({w for ws in words.values() for w in ws})))

    def found(grams: Column, possible: Column) -> Column:
        def passage(t: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(t["grams"], F.get(grams, i)))
            best = F.array_max(F.transform(starts, lambda i: F.struct(dice(F.array_distinct(F.slice(grams, i + 1, t["length"])), t["grams"]).alias("dice"), (-i).alias("at"))))
            return once(best, lambda x: F.struct(t["licence"].alias("licence"), F.lit("passage").alias("scope"), x["dice"].alias("dice"), -x["at"]))

        def document(distinct: Column) -> Column:
            sized = F.filter(possible, lambda t: share * F.size(distinct) <= F.size(t["grams"]))
            return F.transform(sized, lambda t: F.struct(t["licence"].alias("licence"), F.lit("document").alias("scope"), dice(distinct, t["grams"]).alias("dice"), F.lit(0)))

        return F.concat(once(F.array_distinct(grams), document), F.transform(possible, passage))

    def near(grams: Column) -> Column:
        return F.filter(table, lambda t: F.size(F.array_intersect(grams, t["grams"])) >= share * F.size(t["grams"]))

    def scan(words: Column) -> Column:
        # nearly all texts end here
        possible = once(F.array_intersect(words, vocabulary), lambda own: F.exists(table, lambda t: F.size(F.array_intersect(own, t["words"])) >= t["needed"]))
        return F.when(possible, once(bigrams(words), lambda grams: once(near(grams), lambda p: F.when(F.size(p) > 0, found(grams, p)))))

    hits = docs.select(F.col(id_col).alias("id"), F.explode_outer(once(words_of(F.col(text_col).cast("string")), scan)).alias("hit"))
    named = hits.select(F.col("id").alias(id_col), "hit.licence", "hit.scope", F.round("hit.dice", 6).alias("dice"), F.col("hit.col4").cast("long").alias("start_word"))
    return named.filter(F.col("dice") >= threshold)


def oracle_sql(threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL for the rows of `licences` over the table documents."""
    share = threshold / (2 - threshold)
    values = ", ".join(f"('{k}', {list(dict.fromkeys(g := template_bigrams(t)))}, {len(g)})" for k, t in templates.items())
    return rf"""WITH t(licence, grams, length) AS (VALUES {values}),
w AS (SELECT row_number() OVER () k, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') w FROM documents),
g AS (SELECT k, doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END g FROM w),
c AS (SELECT k, doc_id, licence, grams, length, g, list_distinct(g) d FROM g, t WHERE len(list_intersect(g, grams)) >= {share} * len(grams)),
p AS (SELECT k, doc_id, licence, grams, i, list_distinct(g[i + 1 : i + length]) d FROM (SELECT *, unnest(range(0, len(g))) i FROM c) WHERE list_contains(grams, g[i + 1])),
h AS (SELECT k, doc_id, licence, 'document' AS scope, 2 * len(list_intersect(d, grams)) / (len(d) + len(grams)) dice, 0 AS i FROM c
 UNION ALL SELECT k, doc_id, licence, 'passage', 2 * len(list_intersect(d, grams)) / (len(d) + len(grams)), i FROM p)
SELECT doc_id, licence, scope, round(max(dice), 6) dice, CAST(arg_max(i, dice * 1e9 - i) AS BIGINT) start_word FROM h GROUP BY k, doc_id, licence, scope HAVING round(max(dice), 6) >= {threshold}"""
