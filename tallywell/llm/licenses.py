"""License scans: word windows against licence templates by the Dice coefficient over word bigrams, in built-in functions.

The whole text is normalised (A-Z in lower case, whatever is no letter or digit a blank), so it does not matter how it is
wrapped. A template of w words is compared with windows of w words, which stand where the text has one of the template's
anchors: of two sets with a coefficient of d or more the smaller holds d / (2 - d) of the larger one's bigrams at least, so
a match holds one of any set of bigrams that is larger by one than what may be missing. The longest, which other texts
rarely hold, are the anchors. An anchor fixes the window's place; the same bounds on the sizes of two such sets prune texts
and windows before bigrams are compared. Matching windows of a template that overlap are one notice. Everything
happens within the row: no shuffle, no join.

Defined cases: a null or empty text has no notice; texts shorter than every template's bound match nothing; windows reach
over the ends of a text and hold fewer words there; of windows with equal coefficients the first counts; repeated rows
give equal values; other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.plans.once import once

#: Least Dice coefficient, in percent.
PERCENT = 80

# Whole texts and headers of public licences, and usual notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met:""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-program": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pairs(text: str) -> list[str]:
    """The word bigrams of a text by place."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def size_bounds(size: int, percent: int) -> tuple[int, int]:
    """Least and most distinct bigrams of a window that can match a template of so many."""
    return math.ceil(size * percent / (200 - percent)), size * (200 - percent) // percent


def anchors(text: str, percent: int) -> list[tuple[str, int]]:
    """(bigram, place in the template) of the longest bigrams, of which a match holds one at least."""
    own = pairs(text)
    distinct = sorted(set(own), key=lambda b: (-len(b), b))
    chosen = set(distinct[: len(distinct) - size_bounds(len(distinct), percent)[0] + 1])
    return [(b, place) for place, b in enumerate(own) if b in chosen]


def _strings(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")  # folded into one literal


def _words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.split(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), " ")


def _pairs(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _matches(name: str, text: str, percent: int) -> Column:
    """(name, first, dice) of the windows of a template that match, from the columns pairs and hits; of those that overlap the best."""
    own = pairs(text)
    distinct, length = list(dict.fromkeys(own)), len(own)
    at = F.from_json(F.lit(json.dumps([{"pair": b, "place": place} for b, place in anchors(text, percent)])), "array<struct<pair: string, place: int>>")
    starts = F.transform(F.col("hits"), lambda h: F.transform(F.filter(at, lambda a: a["pair"] == h["pair"]), lambda a: h["at"] - a["place"]))
    starts = F.array_sort(F.array_distinct(F.flatten(starts)))
    window = lambda s: F.array_distinct(F.slice("pairs", F.greatest(s, F.lit(0)) + 1, F.least(s, F.lit(0)) + length))

    def measured(s: Column) -> Column:
        held = window(s)
        same, total = F.size(F.array_intersect(held, _strings(distinct))), F.size(held) + len(distinct)
        good = F.size(held).between(*size_bounds(len(distinct), percent)) & (200 * same >= percent * total)
        return F.when(good, F.struct(F.lit(name).alias("name"), s.alias("first"), (2 * same / total).alias("dice")))

    good = F.filter(F.transform(starts, measured), lambda m: m.isNotNull())
    one = F.struct(F.lit(name).alias("name"), F.lit(0).alias("first"), F.lit(0.0).alias("dice"), F.lit(0).alias("last"))
    none = F.filter(F.array(one), lambda _: F.lit(False))

    def joined(done: Column, m: Column) -> Column:
        """A window that begins inside the notice before it belongs to it."""
        before = F.element_at(done, -1)
        better = m["dice"] > before["dice"]
        wider = F.struct(before["name"].alias("name"), F.when(better, m["first"]).otherwise(before["first"]).alias("first"), F.greatest(m["dice"], before["dice"]).alias("dice"), m["first"].alias("last"))
        new = F.struct(m["name"].alias("name"), m["first"].alias("first"), m["dice"].alias("dice"), m["first"].alias("last"))
        inside = (F.size(done) > 0) & (m["first"] - before["last"] <= length)
        return F.when(inside, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(new)))

    return F.transform(F.aggregate(good, none, joined), lambda m: F.struct(m["name"].alias("name"), m["first"].alias("first"), m["dice"].alias("dice")))


def _found(docs: DataFrame, templates: dict[str, str] | None, percent: int) -> DataFrame:
    """doc_id and the notices of every document; the windows are looked at only where a text holds an anchor."""
    chosen = dict(sorted((templates or TEMPLATES).items()))
    least = min(size_bounds(len(set(pairs(t))), percent)[0] for t in chosen.values())
    wanted = sorted({b for t in chosen.values() for b, _ in anchors(t, percent)})
    needed, longer = _strings(wanted), _strings(sorted({max(b.split(), key=len) for b in wanted}))
    texts = once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), {"words": _words(F.col("text"))}).drop("text")
    may = (F.size("words") > least) & F.arrays_overlap("words", longer)  # an anchor's longer word alone is cheaper to look for
    texts = once(texts, {"pairs": F.when(may, _pairs(F.col("words")))}).drop("words")
    some = F.col("pairs").isNotNull() & F.arrays_overlap("pairs", needed)
    placed = F.transform("pairs", lambda b, i: F.struct(b.alias("pair"), i.alias("at")))
    hits = once(texts, {"hits": F.when(some, F.filter(placed, lambda h: F.array_contains(needed, h["pair"])))})
    every = F.concat(*(_matches(name, text, percent) for name, text in chosen.items()))
    none = F.filter(F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("first"), F.lit(0.0).alias("dice"))), lambda _: F.lit(False))
    return once(hits, {"found": F.when(F.col("hits").isNotNull(), every).otherwise(none)}).select("doc_id", "found")


def notices(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, licence, first_word (of the best window, from 0; below 0 where it begins before the text), dice of every notice."""
    each = _found(docs, templates, percent).select("doc_id", F.explode("found").alias("m"))
    return each.select("doc_id", F.col("m.name").alias("licence"), F.col("m.first").alias("first_word"), F.col("m.dice").alias("dice"))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_notices, licences (distinct names by name, comma-joined), best_dice of every document."""
    return _found(docs, templates, percent).select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.name"))), ",").alias("licences"),
        F.coalesce(F.array_max(F.col("found.dice")), F.lit(0.0)).alias("best_dice"),
    )


def oracle(percent: int = PERCENT) -> str:
    """The same in DuckDB, by joining the bigrams of texts with anchors, and those of windows with templates."""
    rows = lambda values: ", ".join(values)
    template = rows(f"('{name}', '{b}')" for name, text in sorted(TEMPLATES.items()) for b in sorted(set(pairs(text))))
    anchor = rows(f"('{name}', '{b}', {place})" for name, text in sorted(TEMPLATES.items()) for b, place in anchors(text, percent))
    length = rows(f"('{name}', {len(pairs(text))}, {len(set(pairs(text)))})" for name, text in sorted(TEMPLATES.items()))
    return f"""
    WITH template(name, pair) AS (VALUES {template}), anchor(name, pair, place) AS (VALUES {anchor}), size(name, len, t) AS (VALUES {length}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT r, string_split(trim(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM docs),
    pairs AS (SELECT r, i - 1 AS i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM words)),
    starts AS (SELECT DISTINCT r, name, i - place AS s FROM pairs JOIN anchor USING (pair)),
    held AS (SELECT DISTINCT r, name, s, p.pair FROM starts JOIN size USING (name) JOIN pairs p USING (r) WHERE p.i >= s AND p.i < s + len),
    sized AS (SELECT r, name, s, count(*) AS a FROM held GROUP BY ALL),
    shared AS (SELECT r, name, s, count(*) AS n FROM held JOIN template USING (name, pair) GROUP BY ALL),
    good AS (SELECT r, name, s, len, 2.0::DOUBLE * n / (a + t) AS dice FROM shared JOIN sized USING (r, name, s) JOIN size USING (name)
             WHERE 200 * n >= {percent} * (a + t)),
    first AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY r, name ORDER BY s) > len, true) AS opens FROM good),
    per_doc AS (SELECT r, count(*) FILTER (opens) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS dice FROM first GROUP BY r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(names, '') AS licences, coalesce(dice, 0.0)::DOUBLE AS best_dice
    FROM docs LEFT JOIN per_doc USING (r)"""
