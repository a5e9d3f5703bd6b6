"""License scan: Dice coefficient over word bigrams against license templates, pruned by size bounds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import once

THRESHOLD = 0.8
DROPPED_LINES = r"(?im)^[^a-z0-9\n]*(?:copyright\b|\(c\)|all rights reserved)[^\n]*$"
NOT_WORD = "[^a-z0-9]+"

# Texts of public licenses.
TEMPLATES = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
}


def _words(text: Column) -> Column:
    """Lower-case words without notice lines and punctuation."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, DROPPED_LINES, " ")), NOT_WORD, " ")
    return F.filter(F.split(plain, " "), lambda x: x != "")


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """Normalised bigram set of every template."""
    out = {}
    for name, text in templates.items():
        w = [x for x in re.sub(NOT_WORD, " ", re.sub(DROPPED_LINES, " ", text).lower()).split(" ") if x]
        out[name] = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: best matching license, its Dice coefficient and the number of bigrams.

    ``2 min(a, b) / (a + b)`` bounds the coefficient from above, so a template is compared only with
    documents whose set size lies within ``t / (2 - t)`` and ``(2 - t) / t`` of its own. The templates
    are a parameter of the job and sit in the plan as literals; nothing is shuffled. Null or one-word texts have no
    bigrams and no license; ties go to the first name; repeated rows are judged one by one.
    """
    t = threshold
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = template_bigrams(TEMPLATES if templates is None else templates)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("doc_id", once(_words(F.col("text"))).alias("w"))
    base = base.select("doc_id", once(F.expr(
        "IF(size(w) < 2, CAST(array() AS array<string>), array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))))"
    )).alias("g"))
    n = F.size("g")
    scores = []
    for name, grams in sorted(sets.items()):
        m = len(grams)
        fits = (n * (2 - t) >= t * m - 1e-9) & (n * t <= (2 - t) * m + 1e-9) & (n > 0)
        lit = F.array(*[F.lit(x) for x in grams]) if grams else F.array().cast("array<string>")
        dice = F.lit(2.0) * F.size(F.array_intersect("g", lit)) / (n + m)
        scores.append(F.struct(F.when(fits, dice).alias("dice"), F.lit(name).alias("license")))
    found = F.filter(F.array(*scores), lambda s: s["dice"] >= t) if scores else F.array().cast("array<struct<dice:double,license:string>>")
    best = F.aggregate(
        found, F.lit(None).cast("struct<dice:double,license:string>"),
        lambda a, s: F.when(a.isNull() | (s["dice"] > a["dice"]), s).otherwise(a),
    )
    return base.select("doc_id", n.cast("long").alias("n_bigrams"), best.alias("b")).select(
        "doc_id", "n_bigrams", F.col("b.license").alias("license"), F.round(F.col("b.dice"), 6).alias("dice")
    )


def _sql() -> str:
    rows = ", ".join(f"('{n}', [{', '.join(chr(39) + g + chr(39) for g in gs)}])" for n, gs in sorted(template_bigrams(TEMPLATES).items()))
    pattern = DROPPED_LINES.replace("(?im)", "")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''),
    '(?im){pattern}', ' ', 'g')), '{NOT_WORD}', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT r, doc_id, CASE WHEN len(w) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d
), t(license, tg) AS (VALUES {rows}
), s AS (
  SELECT r, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM g, t WHERE len(g) > 0 AND len(g) <= 4 * len(tg)
), b AS (SELECT r, license, dice FROM s WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, license) = 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_bigrams, license, round(CAST(dice AS DOUBLE), 6) AS dice FROM g LEFT JOIN b USING (r)
"""


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


SQL = _sql()
