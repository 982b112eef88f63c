"""Licence scan with DataFrame operations only.

What a file says of its licence is compared in units: every line with an anchor word of a licence notice, every block of consecutive
comment lines that holds one (so wrapped headers count as a whole), and the whole text of a file named like a licence file.
Units are split in terms, weighted by TF-IDF, and compared with licence templates (whole short licences, standard headers,
one-line notices) by sparse cosine: terms are joined to the templates' weights and products are added up. The inverse document
frequencies come from the templates, a fixed table of some hundred terms, so a notice that most files carry doesn't lose its weight. A file
named like a licence file holds for its directory and all below it; a file without a notice of its own takes the licence of its
nearest ancestor directory that has one, found by joining its directory's ancestors (one row for each path level). Texts are read once;
paths and units are written.

Null and empty texts have no notice and may inherit. Of equal cosines the earlier unit (lines, then blocks, then the text), then the
earlier template decides; of several licence files in a directory that with the smallest id counts. Rows that repeat a doc_id are one file:
they share the best notice of their texts. A null source, language or id stands for 'none' in paths. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake

#: Permission notices, standard headers and one-line notices that are compared; fixed values, public texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-2.0", "This program is free software licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("MIT", """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
ANCHORS = ("licen", "permission", "redistribution")
THRESHOLD = 0.7
#: A run of lines that each begin with a comment mark.
COMMENT = r"(?:^[ \t]*(?:#|//|/\*|\*|--|;|%|<!--).*\n?)+"
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying)[^/]*$"


def template_weights() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight / norm) rows, idf of the templates' terms, idf of other terms."""
    terms = [Counter(x for x in re.split("[^a-z0-9]+", text.lower()) if x) for _, text in TEMPLATES]
    df = Counter(t for c in terms for t in c)
    idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in df.items()}
    other = math.log(1 + len(terms)) + 1
    rows = []
    for i, ((name, _), c) in enumerate(zip(TEMPLATES, terms, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, other


def units(files: DataFrame) -> DataFrame:
    """Rows (doc_id, path, units) of files (doc_id, path, text). units: the texts to compare, in order, or null."""
    anchor = "|".join(ANCHORS)
    named = lambda x: F.lower(x).rlike(anchor)
    found = F.concat(
        F.filter(F.split("text", "\n"), named),
        F.filter(F.regexp_extract_all("text", F.lit("(?md)" + COMMENT), F.lit(0)), named),
        F.when(F.col("path").rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>")),
    )
    return files.select("doc_id", "path", F.when(named(F.col("text")), found).alias("units"))


def notices(files: DataFrame) -> DataFrame:
    """Rows (doc_id, licence, cosine): the best notice of each file (doc_id, units) that has one of at least THRESHOLD."""
    spark = files.sparkSession
    rows, idf, other = template_weights()
    weights = spark.createDataFrame(rows, "template int, licence string, term string, weight double")
    idfs = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    found = files.where("units is not null").select("doc_id", F.posexplode("units").alias("unit", "value"))
    terms = found.select("doc_id", "unit", F.xxhash64("value").alias("of"), F.explode(F.split(F.lower("value"), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    tf = terms.groupBy("doc_id", "unit", "of", "term").agg(F.count("*").alias("tf"))
    # The templates' terms are a fixed table of some hundred rows: broadcast is bounded.
    tf = tf.join(F.broadcast(idfs), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy("doc_id", "unit", "of").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), "term").groupBy("doc_id", "unit", "of", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    both = dots.join(norms.hint("merge"), ["doc_id", "unit", "of"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= THRESHOLD)
    best = both.groupBy("doc_id").agg(F.max_by(F.struct("licence", "cosine"), F.struct("cosine", -F.col("unit"), -F.col("template"))).alias("b"))
    return best.select("doc_id", "b.licence", "b.cosine")


def scan(files: DataFrame) -> DataFrame:
    """Rows (doc_id, path, licence, cosine, origin, licence_dir) of files (doc_id, path, text). origin: own, inherited, none."""
    files = lake.written(units(files), "units")
    own = lake.written(notices(files), "notices")
    directory = F.regexp_replace("path", "/[^/]*$", "")
    paths = files.select("doc_id", "path", directory.alias("dir")).join(own.hint("merge"), "doc_id", "left")
    holders = paths.where(F.col("licence").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("dir").agg(F.min_by("licence", F.struct("doc_id", "licence")).alias("dir_licence"))
    holders = lake.written(holders, "holders")
    steps = F.split("dir", "/")
    above = files.select(directory.alias("dir")).distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(steps)))).withColumn("above", F.array_join(F.slice(steps, 1, F.col("depth")), "/"))
    nearest = above.join(holders.select(F.col("dir").alias("above"), "dir_licence").hint("merge"), "above").groupBy("dir").agg(F.max_by(F.struct("dir_licence", "above"), "depth").alias("from"))
    nearest = lake.written(nearest.select("dir", "from.dir_licence", F.col("from.above").alias("above")), "nearest")
    out = paths.join(nearest.hint("merge"), "dir", "left")
    has = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("licence", "dir_licence").alias("licence"), "cosine",
        F.when(has, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~has, F.col("above")).alias("licence_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """A file tree over documents, which have no paths: source / language / 256 ids a directory. A text whose first line holds an
    anchor is named LICENSE and lies at the depth given by its id modulo 3."""
    s, g, i = (F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("source", "lang", "doc_id"))
    part = F.concat(F.lit("d"), F.coalesce(F.expr("cast(doc_id div 256 as string)"), F.lit("none")))
    first = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    depth = F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0))
    tree = F.when(depth == 0, s).when(depth == 1, F.concat_ws("/", s, g)).otherwise(F.concat_ws("/", s, g, part))
    notice = first.rlike("|".join(ANCHORS))
    path = F.when(notice, F.concat(tree, F.lit("/LICENSE-"), i)).otherwise(F.concat(F.concat_ws("/", s, g, part), F.lit("/doc-"), i, F.lit(".txt")))
    return docs.select("doc_id", "text", path.alias("path"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(lake.table(spark, sf_dir, "documents")))


def _op8_sql() -> str:
    rows, idf, other = template_weights()
    w = ",".join(f"({i},'{n}','{t}',{x!r}::double)" for i, n, t, x in rows)
    d = ",".join(f"('{t}',{x!r}::double)" for t, x in sorted(idf.items()))
    anchor = "|".join(ANCHORS)
    return f"""
WITH w(template, licence, term, weight) AS (VALUES {w}), i(term, idf) AS (VALUES {d}),
f AS (SELECT doc_id, text, CASE WHEN regexp_matches(lower(split_part(coalesce(text,''), chr(10), 1)), '{anchor}') THEN
  CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source||'/'||lang ELSE source||'/'||lang||'/d'||(doc_id // 256) END || '/LICENSE-'||doc_id
  ELSE source||'/'||lang||'/d'||(doc_id // 256)||'/doc-'||doc_id||'.txt' END AS path FROM documents),
u AS (SELECT doc_id, list_concat(list_concat(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '{anchor}')), list_filter(regexp_extract_all(text, '(?m){COMMENT}'), lambda x: regexp_matches(lower(x), '{anchor}'))),
  CASE WHEN path LIKE '%/LICENSE-%' THEN [text] ELSE [] END) AS units FROM f WHERE regexp_matches(lower(text), '{anchor}')),
l AS (SELECT doc_id, unnest(units) AS value, generate_subscripts(units, 1) AS line FROM u),
t AS (SELECT doc_id, line, unnest(string_split_regex(lower(value), '[^a-z0-9]+')) AS term FROM l),
tf AS (SELECT doc_id, line, term, count(*) * coalesce(any_value(idf), {other!r}::double) AS w FROM t LEFT JOIN i USING (term) WHERE term <> '' GROUP BY doc_id, line, term),
n AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM tf GROUP BY doc_id, line),
c AS (SELECT doc_id, line, template, licence, round(sum(tf.w * weight) / any_value(norm), 6) AS cosine FROM tf JOIN w USING (term) JOIN n USING (doc_id, line) GROUP BY ALL),
b AS (SELECT * FROM c WHERE cosine >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, line, template) = 1),
p AS (SELECT f.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, licence, cosine FROM f LEFT JOIN b USING (doc_id)),
h AS (SELECT dir AS above, arg_min(licence, doc_id) AS dir_licence FROM p WHERE licence IS NOT NULL AND path LIKE '%/LICENSE-%' GROUP BY dir),
a AS (SELECT p.doc_id, above, dir_licence FROM p JOIN h ON p.dir = above OR starts_with(p.dir, above || '/') QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY length(above) DESC) = 1)
SELECT p.doc_id, path, coalesce(licence, dir_licence) AS licence, cosine, CASE WHEN licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN licence IS NULL THEN above END AS licence_dir FROM p LEFT JOIN a USING (doc_id)"""


ORACLE = _op8_sql()
