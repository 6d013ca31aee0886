"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. A file's *units* are its sentences, its paragraphs where it has several, and its whole text. A unit's vector has
tf * idf of its terms; the idf of every term is counted over the sentences of all files. Templates are short notices, standard headers of source files,
identifier lines and the bodies of licences. A part with a cosine of ``least`` or more to a template is a licence header and gives
the file its licence. A file is a licence *file* when its whole text reaches ``least``, or when it is named LICENSE, LICENCE or
COPYING and holds a header; it then gives its licence to its directory. A file without a licence takes that of the nearest
directory above it that has one, found by equi-joins on directory paths; directories are made distinct before that, so a directory
of a third of all files is one row.

The only rows that reach the driver are counts of template terms. Rows of the template tables are broadcast; their number is that
of the fixed templates' terms. Filters before the vectors are exact: a unit that reaches ``least`` must hold an *anchor*, as
the weight of all other terms of any template is too small.

Defined results: null and empty texts have no own licence and may inherit; null paths are a top directory of their own; of equal cosines the template that sorts first wins;
rows of one path and text, and rows that are equal in all, are each told; very long texts are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, read_table, release

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either
version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name}
along with this program."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

# Notices, headers and bodies of licences.
TEXTS = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format(name="Affero General Public License", version="3")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD_HEAD + _BSD_TAIL],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "EPL-2.0": ["Made available under the Eclipse Public License, version 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format(name="General Public License", version="2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format(name="General Public License", version="3")],
    "ISC": ["Released under the ISC License.", _ISC],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format(name="Lesser General Public License", version="2.1")],
    "MIT": ["Released under the MIT License.", _MIT],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, version 2.0.", _MPL],
    "Unlicense": ["Released into the public domain under the Unlicense.", _UNLICENSE],
}
# A template is named by its licence and a number; each licence has its identifier line, too.
TEMPLATES = {f"{name}#{k}": text for name, texts in TEXTS.items() for k, text in enumerate([*texts, f"SPDX-License-Identifier: {name}"])}
TERM = "([a-z0-9]+(?:[.-][a-z0-9]+)*)"
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"
LEAST = 0.6


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


TEMPLATE_TERMS = sorted({t for text in TEMPLATES.values() for t in terms_of(text)})


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), "\n")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that has several."""
    parts = F.split(text, r"\n[ \t\r]*\n[ \t\r\n]*")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def term_counts(files: DataFrame) -> DataFrame:
    """(term, n): the sentences of all files that hold the term; the empty term counts all sentences."""
    units = files.where(F.col("text").isNotNull()).select(F.explode(sentences(F.col("text"))).alias("unit")).where("unit <> ''")
    held = F.array_distinct(F.concat(F.array(F.lit("")), terms(F.col("unit"))))
    return materialize(units.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "terms")


def template_weights(idf: dict[str, float]) -> list[tuple[str, str, float]]:
    """(template, term, weight), of length one for each template."""
    out = []
    for name, text in TEMPLATES.items():
        told = terms_of(text)
        w = {t: told.count(t) * idf[t] for t in sorted(set(told))}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out += [(name, t, x / norm) for t, x in w.items()]
    return out


def anchors(weights: list[tuple[str, str, float]], idf: dict[str, float], least: float) -> list[str]:
    """The rarest terms, as many as it takes until the other terms of any template can't reach ``least``."""
    chosen: set[str] = set()
    for t in sorted(idf, key=lambda t: (-idf[t], t)):
        rest: dict[str, float] = {}
        for name, term, w in weights:
            if term not in chosen:
                rest[name] = rest.get(name, 0.0) + w * w
        if all(math.sqrt(x) < least - 1e-9 for x in rest.values()):
            break
        chosen.add(t)
    return sorted(chosen)


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row of ``files`` (id, path, text): id, path, license, how (own, inherited or none), cosine."""
    spark = files.sparkSession
    held_by = term_counts(files)
    release(spark)
    known = {r["term"]: r["n"] for r in held_by.where(F.col("term").isin("", *TEMPLATE_TERMS)).collect()}
    total = known.get("", 0)
    idf = {t: math.log((total + 1) / (known.get(t, 0) + 1)) + 1 for t in TEMPLATE_TERMS}
    weights = template_weights(idf)
    held = F.array(*map(F.lit, anchors(weights, idf, least)))
    named = files.select("id", F.coalesce("path", F.lit("")).alias("path"), "text", F.xxhash64("text").alias("content"))
    # unit 0 is the whole text, the others are its parts
    parts = F.concat(F.array("text"), paragraphs(F.col("text")), sentences(F.col("text")))
    units = named.where(F.arrays_overlap(terms(F.col("text")), held)).select("path", "content", F.posexplode(parts).alias("unit", "words"))
    units = units.select("path", "content", "unit", terms(F.col("words")).alias("terms")).where(F.arrays_overlap("terms", held)).dropDuplicates(["path", "content", "unit"])
    counts = materialize(units.select("path", "content", "unit", F.explode("terms").alias("term")).groupBy("path", "content", "unit", "term").agg(F.count("*").alias("tf")), "counts")
    weight_of = spark.createDataFrame(weights, "template string, term string, weight double")
    key = ["path", "content", "unit"]
    valued = counts.join(held_by, "term").select(*key, "term", (F.col("tf") * (F.log((F.lit(total) + 1.0) / (F.col("n") + 1.0)) + 1)).alias("x"))
    valued = materialize(valued, "valued")
    discard(counts)
    discard(held_by)
    norms = valued.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = valued.join(F.broadcast(weight_of), "term").groupBy(*key, "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    # of equal cosines the first name: the least pair of (-cosine, name)
    found = cosines.groupBy("path", "content").agg(
        F.min(F.when(F.col("unit") > 0, F.struct((-F.col("cosine")).alias("minus"), "template"))).alias("header"),
        F.min(F.when(F.col("unit") == 0, F.struct((-F.col("cosine")).alias("minus"), "template"))).alias("whole"),
    )
    own = found.select("path", "content", F.coalesce("header", "whole").alias("own"), F.when(F.col("path").rlike(LICENSE_NAME), F.coalesce("whole", "header")).otherwise(F.col("whole")).alias("gives"))
    folder = lambda path: F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    given = own.where(F.col("gives").isNotNull()).select(folder(F.col("path")).alias("above"), F.col("gives.minus").alias("minus_"), F.col("gives.template").alias("template"))
    given = given.groupBy("above").agg(F.min(F.struct(F.col("minus_").alias("minus"), "template")).alias("given"))
    # the folders of all files, each with the folders above it and itself
    folders = named.select(folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    near = folders.select("folder", F.explode(F.array_distinct(above)).alias("above")).join(given, "above")
    inherited = near.groupBy("folder").agg(F.max_by("given", F.length("above")).alias("given"))
    out = named.select("id", "path", "content", folder(F.col("path")).alias("folder")).join(own.select("path", "content", "own"), ["path", "content"], "left").join(inherited, "folder", "left")
    license = F.coalesce("own", "given")
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", F.split(license["template"], "#")[0].alias("license"), how.alias("how"), (-license["minus"]).alias("cosine"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files: their source is the top directory, then one for each thousand ids and one for each hundred; of five scores of ids one is the hundreds' licence files, one those of the thousand."""
    docs = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    score, thousand, hundred = F.floor(i / 20) % 5, F.floor(i / 1000).cast("string"), F.floor(i / 100).cast("string")
    name = F.when(score == 0, F.concat_ws("/", thousand, hundred, F.lit("LICENSE"))).when(score == 1, F.concat_ws("/", thousand, F.lit("COPYING"))).otherwise(F.concat_ws("/", thousand, hundred, F.concat(i.cast("string"), F.lit(".txt"))))
    path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), name)
    out = scan(docs.select(i.alias("id"), F.coalesce(path, F.lit("unknown")).alias("path"), "text"))
    return out.withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    rows = ", ".join(f"('{n}', '{t}', {terms_of(text).count(t)})" for n, text in TEMPLATES.items() for t in sorted(set(terms_of(text))))
    return f"""
WITH RECURSIVE template_terms(template, term, tf) AS (VALUES {rows}),
files AS (
  SELECT doc_id, text, coalesce(source, 'unknown') || '/' || CASE WHEN doc_id // 20 % 5 = 0 THEN (doc_id // 1000) || '/' || (doc_id // 100) || '/LICENSE'
    WHEN doc_id // 20 % 5 = 1 THEN (doc_id // 1000) || '/COPYING' ELSE (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM documents),
sentences AS (
  SELECT doc_id, path, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))) AS words FROM files WHERE text IS NOT NULL),
paragraphs AS (SELECT doc_id, path, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n[ \\t\\r\\n]*') AS p FROM files WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, path, true AS whole, text AS words FROM files WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, path, false, unnest(p) FROM paragraphs WHERE len(p) > 1
  UNION ALL SELECT doc_id, path, false, words FROM sentences),
units AS (SELECT row_number() OVER () AS unit, * FROM parts WHERE words <> ''),
told AS (SELECT unit, doc_id, path, whole, unnest(regexp_extract_all(lower(words), '{TERM}', 1)) AS term FROM units),
counts AS (SELECT unit, doc_id, path, whole, term, count(*) AS tf FROM told GROUP BY ALL),
n AS (SELECT count(*) AS n FROM sentences WHERE words <> ''),
held AS (SELECT unnest(list_distinct(regexp_extract_all(lower(words), '{TERM}', 1))) AS term FROM sentences),
df AS (SELECT term, count(*) AS df FROM held GROUP BY term),
terms AS (SELECT term FROM df UNION SELECT term FROM template_terms),
idf AS (SELECT term, ln((n.n + 1.0) / (coalesce(df.df, 0) + 1.0)) + 1 AS idf FROM terms LEFT JOIN df USING (term) CROSS JOIN n),
w AS (SELECT template, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS w FROM template_terms JOIN idf USING (term)),
valued AS (SELECT c.*, tf * idf AS x FROM counts c JOIN idf USING (term)),
norms AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM valued GROUP BY unit),
dots AS (SELECT unit, doc_id, path, whole, template, sum(x * w) AS dot FROM valued JOIN w USING (term) GROUP BY ALL),
cosines AS (SELECT doc_id, path, whole, template, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (unit) WHERE round(dot / norm, 6) >= {LEAST}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, whole ORDER BY cosine DESC, template) AS place FROM cosines),
header AS (SELECT * FROM ranked WHERE place = 1 AND NOT whole),
full_text AS (SELECT * FROM ranked WHERE place = 1 AND whole),
own AS (SELECT doc_id, coalesce(h.template, w.template) AS template, coalesce(h.cosine, w.cosine) AS cosine FROM header h FULL JOIN full_text w USING (doc_id)),
gives AS (
  SELECT doc_id, path, template, cosine FROM full_text
  UNION ALL SELECT h.doc_id, h.path, h.template, h.cosine FROM header h ANTI JOIN full_text w USING (doc_id) WHERE regexp_matches(h.path, '/(LICENSE|COPYING)$')),
placed AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, template, cosine FROM gives),
given AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY above ORDER BY cosine DESC, template) AS place FROM placed) WHERE place = 1),
above(folder, above) AS (
  SELECT DISTINCT regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '/[^/]*$', '') FROM files
  UNION ALL SELECT folder, CASE WHEN contains(above, '/') THEN regexp_replace(above, '/[^/]*$', '') ELSE '' END FROM above WHERE above <> ''),
inherited AS (
  SELECT folder, template, cosine FROM (SELECT folder, template, cosine, row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) AS place FROM above JOIN given USING (above)) WHERE place = 1)
SELECT f.doc_id, f.path, string_split(coalesce(o.template, i.template), '#')[1] AS license,
  CASE WHEN o.template IS NOT NULL THEN 'own' WHEN i.template IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, coalesce(o.cosine, i.cosine) AS cosine
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN inherited i ON i.folder = regexp_replace(f.path, '/[^/]*$', '')"""


ORACLE = _oracle()
