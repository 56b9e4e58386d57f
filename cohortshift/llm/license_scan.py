"""License scans, native: lines and whole texts against licence templates by Dice over distinct word bigrams.

Normalised words are runs of letters and digits of the lower-cased text. Dice = 2|A and B| / (|A| + |B|).
For Dice >= t the smaller bigram set has at least t / (2 - t) of the larger's size, so a template is
compared only with units whose size lies within these bounds. A unit must also hold that many of a template's
bigrams, so it holds one of a few stems of the templates' words; most texts and lines hold none and are not split
into words. The templates are a fixed table of literals: no join, no shuffle.

Notices that wrap over lines or stand in a longer line are found as passages: runs of consecutive words of the
whole text with at most (2 - t) / t of a template's word pairs. A run reaches t only if it has t / (2 - t) of the
template's distinct bigrams, and an end outside the template never helps, so runs from one of its bigrams to
another cover all positions. Of overlapping runs of a template the best is kept, then of overlapping templates
the one with more common bigrams. A passage is a row of the line it begins in, unless it lies in a line with a
row of its own or the whole text has one. So a line may have two rows: its own and that of a passage from it.

Defined cases: null and empty texts have no bigrams and match nothing; of equal scores the first template in
name order wins; rows without a doc_id are left out; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Public licence statements, headers and whole texts of short licences.
TEMPLATES = {
    "0bsd-text": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby'
        ' granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        'SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
        'LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
        'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING '
        'OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "agpl-3.0-header": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero '
        'General Public License as published by the Free Software Foundation, either version 3 of the License, or (at '
        'your option) any later version.'
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        ' with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
    ),
    "bsd-2-clause-text": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that '
        'the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, '
        'this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the '
        'above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other'
        ' materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS'
        ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        'MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR'
        ' CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
        '(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR'
        ' BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, '
        'OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF '
        'ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "bsd-3-clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that '
        'the following conditions are met:'
    ),
    "bsd-3-clause-text": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that '
        'the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, '
        'this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the '
        'above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other'
        ' materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its '
        'contributors may be used to endorse or promote products derived from this software without specific prior '
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        'EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        'FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE '
        'LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT '
        'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS '
        'INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT '
        '(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE'
        ' POSSIBILITY OF SUCH DAMAGE.'
    ),
    "bsl-1.0-text": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software '
        'and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
        'distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit'
        ' third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices'
        ' in the Software and this entire statement, including the above license grant, this restriction and the '
        'following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative '
        'works of the Software, unless such copies or derivative works are solely in the form of machine-executable '
        'object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        'ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        'PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING'
        ' THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING '
        'FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-header": (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General '
        'Public License as published by the Free Software Foundation; either version 2 of the License, or (at your '
        'option) any later version.'
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General '
        'Public License as published by the Free Software Foundation, either version 3 of the License, or (at your '
        'option) any later version.'
    ),
    "isc-text": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby'
        ' granted, provided that the above copyright notice and this permission notice appear in all copies. THE '
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        'ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,'
        ' DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR '
        'PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN '
        'CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "lgpl-2.1-header": (
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser '
        'General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at'
        ' your option) any later version.'
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        'limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the '
        'Software, and to permit persons to whom the Software is furnished to do so, subject to the following '
        'conditions: The above copyright notice and this permission notice shall be included in all copies or '
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        'OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
        'AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR '
        'OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION '
        'WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-text": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, '
        'publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, '
        'for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright '
        'laws, the author or authors of this software dedicate any and all copyright interest in the software to the '
        'public domain. We make this dedication for the benefit of the public at large and to the detriment of our '
        'heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all '
        'present and future rights to this software under copyright law.'
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        'held liable for any damages arising from the use of this software. Permission is granted to anyone to use this'
        ' software for any purpose, including commercial applications, and to alter it and redistribute it freely, '
        'subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not'
        ' claim that you wrote the original software. If you use this software in a product, an acknowledgment in the '
        'product documentation would be appreciated but is not required. 2. Altered source versions must be plainly '
        'marked as such, and must not be misrepresented as being the original software. 3. This notice may not be '
        'removed or altered from any source distribution.'
    ),
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of sets that can reach the threshold with a set of n."""
    lo, hi = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return int(-(-lo // 1)), int(hi)


def _words(unit: str) -> Column:
    return F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _bigrams(words: str) -> Column:
    return F.expr(f"array_distinct(transform(if(size({words}) > 1, sequence(1, size({words}) - 1), cast(array() as array<int>)), i -> concat(get({words}, i - 1), ' ', get({words}, i))))")


def needed_stems(known: dict[str, list[str]], least: dict[str, int], size: int = 7) -> list[str]:
    """Few stems, one of which is in any text with `least` of a template's bigrams: greedily, those in most bigrams.

    A stem is the first `size` letters of a word; shorter words are stems only where those do not suffice.
    """
    rest, out = {k: list(v) for k, v in known.items()}, []
    while open_ := {k: v for k, v in rest.items() if len(v) >= least[k]}:
        stems = {w[:size] for v in open_.values() for g in v for w in g.split(" ")}
        stems = {x for x in stems if len(x) == size} or stems
        gain = lambda x: sum(x in w for v in open_.values() for g in v for w in g.split(" "))
        out.append(max(sorted(stems), key=gain))
        rest = {k: [g for g in v if not any(out[-1] in w for w in g.split(" "))] for k, v in rest.items()}
    return sorted(out)


def _holding(df: DataFrame, text: str, stems: list[str]) -> DataFrame:
    """Rows whose text holds a stem. explode() of one array keeps the optimiser from lower-casing it for each."""
    low = df.select("*", F.explode(F.array(F.lower(text))).alias("__l"))
    return low.where(" or ".join(f"contains(__l, '{x}')" for x in stems)).drop("__l")


def _array(values) -> str:
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


RUN = "array<struct<s: int, e: int, line: int, last: int, common: int, license: string, dice: double>>"


def _apart(runs: str, first: str) -> str:
    """Runs that overlap no run before them in the given order."""
    order = f"(a, b) -> case {first} when a.s <> b.s then a.s - b.s when a.e <> b.e then a.e - b.e when a.license < b.license then -1 when a.license > b.license then 1 else 0 end"
    return f"aggregate(array_sort({runs}, {order}), cast(array() as {RUN}), (kept, x) -> if(exists(kept, k -> k.s <= x.e and x.s <= k.e), kept, concat(kept, array(x))))"


def _runs(name: str, grams: list[str], pairs: int, threshold: float) -> str:
    """The best runs of one template, from __h (its and other templates' bigrams by place) and __g (all bigrams)."""
    least, _ = size_bounds(len(grams), threshold)
    _, most = size_bounds(pairs, threshold)
    distinct = lambda low, high: f"size(array_distinct(transform(filter(own, x -> x.i between {low} and {high}), x -> x.b)))"
    ends = f"transform(filter(own, e -> e.i between s.i and s.i + {most - 1}), e -> named_struct('s', s.i, 'e', e.i, 'line', s.line, 'last', e.last, 'common', {distinct('s.i', 'e.i')}, 'license', '{name}', 'n', size(array_distinct(transform(slice(__g, s.i + 1, e.i - s.i + 1), x -> x.b)))))"
    scored = f"transform(filter({ends}, r -> r.common >= {least}), r -> named_struct('s', r.s, 'e', r.e, 'line', r.line, 'last', r.last, 'common', r.common, 'license', r.license, 'dice', 2D * r.common / (r.n + {len(grams)})))"
    starts = f"filter(own, s -> {distinct('s.i', f's.i + {most - 1}')} >= {least})"
    found = f"filter(flatten(transform({starts}, s -> {scored})), r -> r.dice >= {threshold}D)"
    best = _apart("found", "when a.dice > b.dice then -1 when a.dice < b.dice then 1")
    return f"transform(array(filter(__h, x -> array_contains({_array(grams)}, x.b))), own -> transform(array({found}), found -> {best})[0])[0]"


def passages(docs: DataFrame, known: dict[str, list[str]], pairs: dict[str, int], threshold: float) -> DataFrame:
    """(doc_id, line_no, license, dice) of runs of words that neither a line's nor the whole text's row shows."""
    bounds = {k: size_bounds(len(v), threshold) for k, v in known.items()}
    row = lambda name, e: F.explode(F.array(F.expr(e))).alias(name)
    unit = r"filter(split(lower(u), '[^\\p{L}\\p{N}]+', -1), w -> w <> '')"
    d = docs.select("doc_id", row("__w", f"flatten(transform(split(text, '\\n', -1), (u, i) -> transform({unit}, w -> struct(w as w, i as line))))")).where("size(__w) > 1")
    d = d.select("doc_id", row("__g", "transform(sequence(0, size(__w) - 2), i -> named_struct('i', i, 'b', concat(get(__w, i).w, ' ', get(__w, i + 1).w), 'line', get(__w, i).line, 'last', get(__w, i + 1).line))"))
    every = ", ".join(f"'{g}'" for g in sorted({g for v in known.values() for g in v}))
    d = d.select("doc_id", "__g", row("__h", f"filter(__g, x -> x.b in ({every}))")).where(F.size("__h") >= min(lo for lo, _ in bounds.values()))
    runs = "concat(" + ", ".join(_runs(k, v, pairs[k], threshold) for k, v in known.items()) + ")"
    d = d.select("doc_id", "__g", row("__r", runs)).where("size(__r) > 0")
    d = d.select("doc_id", "__g", row("__r", _apart("__r", "when a.common <> b.common then b.common - a.common when a.dice > b.dice then -1 when a.dice < b.dice then 1")))
    shown = " or ".join(f"(size(__b) between {bounds[k][0]} and {bounds[k][1]} and 2D * size(array_intersect(__b, {_array(v)})) / (size(__b) + {len(v)}) >= {threshold}D)" for k, v in known.items())
    d = d.select("doc_id", "__g", "__r", row("__b", "array_distinct(transform(__g, x -> x.b))")).where(f"not ({shown})")
    d = d.select("doc_id", "__g", F.explode("__r").alias("__r"))
    own = d.select("doc_id", "__r", row("__b", "array_distinct(transform(filter(__g, x -> x.line = __r.line and x.last = __r.line), x -> x.b))"))
    return own.where(f"__r.line <> __r.last or not ({shown})").select("doc_id", F.col("__r.line").cast("long").alias("line_no"), "__r.license", F.expr("round(__r.dice, 9)").alias("dice"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, line_no, license, dice): the best template of each line, of each whole text as line -1, and passages."""
    known = {k: template_bigrams(v) for k, v in sorted((templates or TEMPLATES).items())}
    bounds = {k: size_bounds(len(v), threshold) for k, v in known.items()}
    least = min(lo for lo, _ in bounds.values())
    # a text that reaches the threshold holds at least the lower bound of a template's bigrams
    stems = needed_stems(known, {k: lo for k, (lo, _) in bounds.items()})
    d = _holding(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), "text", stems)
    lines = _holding(d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "unit")), "unit", stems)
    whole = d.where(F.instr("text", "\n") > 0).select("doc_id", F.lit(-1).alias("line_no"), F.col("text").alias("unit"))
    # explode() of one array keeps the optimiser from copying the words into each of the conditions below
    units = lines.unionByName(whole).select("doc_id", "line_no", F.explode(F.array(_words("unit"))).alias("__w")).where(F.size("__w") > least)
    units = units.select("doc_id", "line_no", F.explode(F.array(_bigrams("__w"))).alias("__b")).withColumn("__n", F.size("__b"))
    units = units.where(" or ".join(f"__n between {lo} and {hi}" for lo, hi in sorted(set(bounds.values()))))
    scores = []
    for name, grams in known.items():
        lo, hi = bounds[name]
        common = F.size(F.array_intersect("__b", F.array(*map(F.lit, grams))))
        dice = (F.lit(2.0) * common) / (F.col("__n") + F.lit(len(grams)))
        scores.append(F.when(F.col("__n").between(lo, hi), F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
    ranked = units.withColumn("__s", F.array(*scores))
    best = F.expr(f"array_sort(filter(__s, x -> x is not null and x.dice >= {threshold}D), (a, b) -> case when a.dice > b.dice then -1 when a.dice < b.dice then 1 when a.license < b.license then -1 else 1 end)")
    found = ranked.withColumn("__best", best).where(F.size("__best") > 0).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.expr("__best[0].license").alias("license"), F.expr("round(__best[0].dice, 9)").alias("dice"))
    pairs = {k: len(re.findall(r"[^\W_]+", v.lower())) - 1 for k, v in (templates or TEMPLATES).items()}
    return found.unionByName(passages(d, known, pairs, threshold))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = ", ".join("('" + k + "', [" + ", ".join(f"'{g}'" for g in template_bigrams(v)) + "])" for k, v in sorted(TEMPLATES.items()))
    return f"""
WITH tpl(license, tb) AS (VALUES {rows}),
units AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS unit
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE doc_id IS NOT NULL AND contains(text, chr(10))),
w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(unit), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM units),
b AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) >= 2),
s AS (
  SELECT doc_id, line_no, license, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
  FROM b JOIN tpl ON len(b) BETWEEN len(tb) / 1.6 AND len(tb) * 1.6),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license) AS k FROM s WHERE dice >= 0.8)
SELECT doc_id, line_no::BIGINT AS line_no, license, round(dice, 9) AS dice FROM r WHERE k = 1
"""


ORACLE = _oracle()
