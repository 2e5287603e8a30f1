"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

Every line, sentence and paragraph of every whole text is a possible header, also where it is wrapped over lines, and the whole text
a possible licence file; so is a file whose name says so. Templates are notices and whole licence texts. Terms are
runs of letters and digits in lower case; the inverse document frequency of each comes from all documents. A unit is scored only if it
holds an anchor: a term set chosen such that a unit without any of it cannot reach the threshold, so nothing is
lost. Documents without a license of their own inherit from the licence file in the nearest ancestor directory, by a join on
paths: directories are reduced to distinct ones first, so a crowded directory is one row there.

All is DataFrame code. Null texts count as empty, null path parts as empty names. Of equal scores the template named first
wins, of equal licence files the least path. Repeated rows each get their result. An empty table gives an empty result; only the named columns
are read, so extra columns never clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import maybe_broadcast, settle, text_or_empty

THRESHOLD = 0.75
#: Directories beyond this many are joined by a shuffle, not broadcast.
BROADCAST_DIRECTORIES = 50_000
#: Terms beyond this many are joined by a shuffle, not broadcast.
BROADCAST_TERMS = 200_000
#: Fixed value: names of licence files, in lower case.
LICENCE_FILE = "^(un)?licen[cs]e|^copying|^notice"
#: Notices by SPDX id.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # whole texts
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE
IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    # notices that files carry in place of a long text
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
]


def terms_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


VOCABULARY = sorted({t for _, x in TEMPLATES for t in terms_of(x)})


def terms(c: Column) -> Column:
    """Terms of a text column, in order."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n) of every term of all documents, settled."""
    own = docs.select(F.explode(F.array_distinct(terms(text_or_empty()))).alias("term"))
    return settle(own.groupBy("term").agg(F.count("*").alias("n")))


def rarity(n: Column, total: int) -> Column:
    return F.log(F.lit(float(total + 1)) / (n + 1)) + 1


def units_of(text: Column) -> Column:
    """Lines, and sentences in them; sentences over line breaks; paragraphs."""
    lines = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    sentences = F.split(F.regexp_replace(F.regexp_replace(text, r"\n[ \t]*\n", "\u0001"), r"([.!?])[ \t\n]+", "$1\u0001"), "\u0001")
    paragraphs = F.split(text, r"\n[ \t]*\n")
    return F.array_distinct(F.concat(lines, sentences, paragraphs))


def template_weights(weights: dict[str, float]) -> list[tuple[int, str, dict[str, float]]]:
    """(number, license, unit-length weights) of each template."""
    out = []
    for k, (name, text) in enumerate(TEMPLATES):
        w = {t: terms_of(text).count(t) * weights[t] for t in terms_of(text)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append((k, name, {t: x / norm for t, x in w.items()}))
    return out


def anchors(templates, threshold: float, seen: dict[str, int]) -> list[str]:
    """A unit without any of these terms has a cosine below the threshold with every template: the other terms' norm is too small. Terms of few documents are taken first."""
    out: set[str] = set()
    for _, _, w in templates:
        rest = 1.0
        for t, x in sorted(w.items(), key=lambda y: (seen.get(y[0], 0), -y[1], y[0])):
            if rest < threshold * threshold * 0.999:
                break
            out.add(t)
            rest -= x * x
    return sorted(out)


def scan(docs: DataFrame, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, license (null if none), basis (header, file, inherited or none), score and from_directory."""
    total, df = docs.count(), document_frequencies(docs)
    seen = {r["term"]: r["n"] for r in df.where(F.col("term").isin(VOCABULARY)).collect()}  # at most len(VOCABULARY) rows
    weights = {t: math.log((total + 1) / (seen.get(t, 0) + 1)) + 1 for t in VOCABULARY}
    templates = template_weights(weights)
    anchor = r"(^|[^a-z0-9])(" + "|".join(anchors(templates, threshold, seen)) + r")([^a-z0-9]|$)"
    text = text_or_empty()
    held = F.lower(text).rlike(anchor)
    directory = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    base = settle(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("doc_id"),
            path.alias("path"),
            directory.alias("directory"),
            F.lower(F.regexp_extract(path, r"([^/]*)$", 1)).rlike(LICENCE_FILE).alias("named"),
            F.when(held, F.filter(units_of(text), lambda x: F.lower(x).rlike(anchor))).alias("units"),
            F.when(held, text).alias("whole"),
        )
    )
    units = base.where("units is not null").select("uid", F.posexplode(F.concat(F.array("whole"), "units")).alias("unit", "text"))
    bags = units.select("uid", "unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("uid", "unit", "term").agg(F.count("*").alias("tf"))
    spark = docs.sparkSession
    bags = settle(bags)
    known = settle(df.join(bags.select("term").distinct(), "term", "left_semi").select("term", rarity(F.col("n"), total).alias("idf")))
    model = F.broadcast(spark.createDataFrame([(k, t, x) for k, _, w in templates for t, x in w.items()], "template int, term string, w double"))
    names = F.array(*[F.lit(n) for _, n, _ in templates])
    bags = bags.join(maybe_broadcast(known, known.count(), BROADCAST_TERMS), "term").withColumn("x", F.col("tf") * F.col("idf"))
    norms = bags.groupBy("uid", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = bags.join(model, "term").groupBy("uid", "unit", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scores = dots.join(norms, ["uid", "unit"]).select("uid", "template", (F.col("unit") == 0).alias("file"), F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scores.groupBy("uid").agg(F.max(F.struct("file", "score", (-F.col("template")).alias("first"))).alias("best"))
    best = best.select("uid", F.col("best.file").alias("file"), F.col("best.score").alias("score"), F.element_at(names, (1 - F.col("best.first")).cast("int")).alias("license"))
    own = base.drop("units", "whole").join(best, "uid", "left")
    own = settle(own.withColumn("basis", F.when(F.col("license").isNotNull(), F.when(F.col("file") | F.col("named"), "file").otherwise("header"))))
    given = own.where("basis = 'file'").groupBy(F.col("directory").alias("from_directory")).agg(F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), "path")).alias("given"))
    # distinct directories, their ancestors by depth, and the nearest with a licence file
    places = own.where("basis is null").select("directory").distinct()
    parts = F.split("directory", "/")
    ups = places.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("from_directory"))
    near = ups.join(given, "from_directory").groupBy("directory").agg(F.max_by(F.struct("from_directory", "given"), F.length("from_directory")).alias("near"))
    near = settle(near)
    own = own.join(maybe_broadcast(near, near.count(), BROADCAST_DIRECTORIES), "directory", "left")
    inherits = F.col("basis").isNull() & F.col("near").isNotNull()
    return own.select(
        "doc_id",
        F.when(inherits, F.col("near.given.license")).otherwise(F.col("license")).alias("license"),
        F.when(inherits, "inherited").otherwise(F.coalesce("basis", F.lit("none"))).alias("basis"),
        F.when(inherits, F.col("near.given.score")).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(inherits, F.col("near.from_directory")).alias("from_directory"),
    )


def document_path() -> Column:
    """The path that the documents table stands for: /corpus/source/lang/doc_id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit("/corpus/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"), F.lit(".txt"))


def oracle() -> str:
    """The same in DuckDB SQL, without anchors."""
    rows = ", ".join(f"({k}, '{n}', '{t}', {terms_of(x).count(t)})" for k, (n, x) in enumerate(TEMPLATES) for t in sorted(set(terms_of(x))))
    return rf"""
WITH template_terms(template, name, term, tf) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text,
             '/corpus/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(doc_id::VARCHAR, '') || '.txt' AS path FROM documents),
p AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM d),
n AS (SELECT count(*) AS total FROM documents),
dt AS (SELECT DISTINCT uid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
idf AS (SELECT term, ln((total + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM template_terms UNION SELECT term FROM df) CROSS JOIN n LEFT JOIN df USING (term)),
tw AS (SELECT template, name, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM template_terms JOIN idf USING (term)),
u AS (SELECT uid, generate_subscripts(x, 1) - 1 AS unit, unnest(x) AS text
      FROM (SELECT uid, list_prepend(text, list_distinct(list_concat(
        string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
        string_split(regexp_replace(regexp_replace(text, '\n[ \t]*\n', chr(1), 'g'), '([.!?])[ \t\n]+', '\1' || chr(1), 'g'), chr(1)),
        string_split_regex(text, '\n[ \t]*\n')))) AS x FROM d)),
b0 AS (SELECT uid, unit, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM u),
b1 AS (SELECT uid, unit, term, count(*) AS tf FROM b0 GROUP BY ALL),
b AS (SELECT uid, unit, b1.term, tf * idf AS x FROM b1 JOIN idf ON idf.term = b1.term),
norms AS (SELECT uid, unit, sqrt(sum(x * x)) AS norm FROM b GROUP BY ALL),
s AS (SELECT uid, unit, template, name, round(sum(x * w) / any_value(norm), 6) AS score FROM b JOIN tw USING (term) JOIN norms USING (uid, unit) GROUP BY ALL),
best AS (SELECT * FROM s WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY unit = 0 DESC, score DESC, template) = 1),
own AS (SELECT p.*, name AS license, score, CASE WHEN best.uid IS NULL THEN NULL WHEN unit = 0 OR regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '{LICENCE_FILE}') THEN 'file' ELSE 'header' END AS basis FROM p LEFT JOIN best ON best.uid = p.uid),
given AS (SELECT directory AS from_directory, license, score FROM own WHERE basis = 'file' QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, path) = 1),
near AS (SELECT o.uid, g.* FROM own o JOIN given g ON o.basis IS NULL AND (o.directory = g.from_directory OR starts_with(o.directory, g.from_directory || '/'))
         QUALIFY row_number() OVER (PARTITION BY o.uid ORDER BY length(g.from_directory) DESC) = 1)
SELECT doc_id, coalesce(own.license, near.license) AS license, coalesce(basis, CASE WHEN near.uid IS NULL THEN 'none' ELSE 'inherited' END) AS basis,
       coalesce(own.score, near.score, 0.0) AS score, near.from_directory FROM own LEFT JOIN near ON near.uid = own.uid
"""
