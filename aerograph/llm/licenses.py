"""License scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

Everything on the path is a DataFrame function. Text is lower-cased and reduced to
words of a-z and 0-9. Units are every line, every paragraph (where blank lines part
a text into several), the whole text (where it has several lines) and, if asked for, every sentence of a line that has several. A unit and a
template with sets of n and m bigrams and a Dice coefficient of t or more share at
least t * (n + m) / 2 bigrams, hence

* n lies between m * t / (2 - t) and m * (2 - t) / t (the size bounds), and
* one of any m - ceil(t * m / (2 - t)) + 1 bigrams of the template is in the unit.

A text without any of the longer words of those few bigrams (those with a template's longest words) matches nothing and is left out
first. The bigrams of the units left over are joined with an inverted index, a table of bigram, template and template size, under the size bounds, and counted: the
counts are the intersections. The index is broadcast where it has at most ``SMALL`` rows, and joined by a shuffle where it has more.

Null and empty texts, and units of one word, match nothing.
Repeated rows and ties are all returned. The result has the named columns only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
SMALL = 100_000
END = "\x01"  # stands for the end of a sentence inside a line

#: Licence notices and texts, as published.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions:""",
    "mit-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
        OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met:""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
        OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
        OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
        IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution.""",
    "bsl-1.0": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining
        a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included
        in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
        DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}


def normal(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = normal(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def least(m: int, t: float) -> int:
    """Bigrams of a template of ``m`` that any match shares with it."""
    return max(1, math.ceil(t * m / (2 - t) - 1e-9))


def index(templates: dict[str, str], t: float) -> tuple[list[tuple[str, str, int]], list[str]]:
    """(the inverted index: bigram, template, the template's bigrams; the words of which any match holds one)."""
    entries, cues = [], set()
    for name, text in templates.items():
        gs = bigrams(text)
        entries += [(g, name, len(gs)) for g in gs]
        rare = sorted(gs, key=lambda g: (-max(map(len, g.split())), g))[: len(gs) - least(len(gs), t) + 1] if gs else []
        cues |= {max(g.split(), key=lambda w: (len(w), w)) for g in rare}
    return entries, sorted(cues)


def grams_of(words: Column) -> Column:
    """Distinct bigrams of an array of two or more words."""
    n = F.greatest(F.size(words), F.lit(1))  # Spark may look at bigrams before it counts the words
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, sentences: bool = False) -> DataFrame:
    """doc_id, unit (line, paragraph, text or sentence), unit_no (from 0), license, dice (6 digits) of every match."""
    entries, cues = index(TEMPLATES if templates is None else templates, threshold)
    if not entries:
        raise ValueError("no template has two words")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    smallest = math.ceil(min(m for _, _, m in entries) * low - 1e-9)
    low_text = F.lower(df[text])
    marked = F.regexp_replace(low_text, r"[.!?]++[ \t]++", END) if sentences else low_text
    signs = rf"\n{END}" if sentences else r"\n"
    docs = df.select(F.monotonically_increasing_id().alias("row"), df[key].alias("doc_id"), F.regexp_replace(marked, rf"[^a-z0-9{signs}]++", " ").alias("t"))
    docs = docs.filter(F.arrays_overlap(F.split("t", f"[ {signs}]"), F.array(*map(F.lit, cues))))
    pieces = lambda name, array: F.transform(array, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("unit_no"), x.alias("s")))
    lines, paragraphs = F.split("t", "\n"), F.split("t", r"\n[ \n]*\n")
    parted = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(END))), lambda x: F.split(x, END)))
    none = pieces("text", F.slice(F.array(F.lit("")), 1, 0))
    units = F.concat(
        pieces("line", lines),
        F.when(F.size(paragraphs) > 1, pieces("paragraph", paragraphs)).otherwise(none),
        F.when(F.contains("t", F.lit("\n")), pieces("text", F.array("t"))).otherwise(none),
        *([pieces("sentence", parted)] if sentences else []),
    )
    units = docs.select("row", "doc_id", F.explode(units).alias("u")).select("row", "doc_id", "u.unit", "u.unit_no", F.filter(F.split("u.s", f"[ {signs}]+"), lambda w: w != "").alias("w"))
    units = units.filter(F.size("w") > smallest).withColumn("g", grams_of(F.col("w"))).withColumn("n", F.size("g"))
    held = units.select("row", "doc_id", "unit", "unit_no", "n", F.explode("g").alias("gram"))
    values = ", ".join("('{}', '{}', {})".format(g, name.replace("\\", "\\\\").replace("'", "\\'"), m) for g, name, m in entries)
    filed = df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(gram, license, m)")
    filed = F.broadcast(filed) if len(entries) <= SMALL else filed
    met = held.join(filed, "gram").filter((F.col("n") >= F.col("m") * low - 1e-9) & (F.col("n") <= F.col("m") * high + 1e-9))
    out = met.groupBy("row", "doc_id", "unit", "unit_no", "license").agg((F.lit(2.0) * F.count("*") / F.first(F.col("n") + F.col("m"))).alias("dice"))
    return out.filter(F.col("dice") >= threshold - 1e-9).select("doc_id", "unit", "unit_no", "license", F.round("dice", 6).alias("dice"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    rows = ", ".join(f"('{name}', {[*bigrams(text)]!r})" for name, text in TEMPLATES.items())
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) AS v(license, tg)),
docs AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
cut AS (SELECT *, string_split(t, chr(10)) AS lines, string_split_regex(t, '\\n[ \\n]*\\n') AS paragraphs FROM docs),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(lines))) AS unit_no, unnest(lines) AS s FROM cut
  UNION ALL SELECT doc_id, 'paragraph', unnest(range(len(paragraphs))), unnest(paragraphs) FROM cut WHERE len(paragraphs) > 1
  UNION ALL SELECT doc_id, 'text', 0, t FROM cut WHERE len(lines) > 1),
words AS (SELECT doc_id, unit, unit_no, list_filter(string_split_regex(s, '[ \\n]+'), lambda x: x <> '') AS w FROM units),
grams AS (SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, unit_no, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
  FROM grams JOIN templates ON list_has_any(g, tg))
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, license, round(CAST(dice AS DOUBLE), 6) AS dice FROM scored WHERE dice >= {THRESHOLD} - 1e-9
"""


OP2_SQL = oracle()
