"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template is its set of n 5-word shingles, and m the power of two from n on. A document has it if some stretch of 2m of
its shingles, wherever it begins, holds 0.8 of them. Windows of a class m are 3m shingles long and begin every m, so each
such stretch lies whole in a window. A window gets `BANDS` bands of one MinHash each over all its shingles. Of the at most
3m it shares 0.8n with the template, so their Jaccard similarity is at least 0.4m / 3.1m > 0.129, and they meet in some
band with a probability of over 1 - 0.871^160 > 1 - 3e-10. Retrieved templates are verified by counting distinct shingles
over all stretches of the document, as running sums of where each shingle begins and ends to count.

Bands are only computed for windows that can hold a template: a first pass over the texts marks the shingles that any
template has (a semi-join with a list that grows with the templates alone), and a window with fewer of those than 0.8 of
the smallest template of its class can't. So the second pass reads few texts, and only they are ever moved.

Edge cases: null texts and texts or templates under 5 words have no shingles and no matches; several matches of one
template in a document are one row, with the best containment and the first shingle of the template in the first stretch
that has it; documents are told apart by two hashes of id and text, so repeated rows give equal rows; a match of one
template never hides another's; other columns are never read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cleaned, row_keys, stored, table, words_of

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 160

#: Common license notices, as their publishers word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: Whole texts of licenses lie beside this module, one a file, as their publishers give them.
WHOLE_TEXTS = Path(__file__).parent / "licenses"


def templates() -> list[tuple[str, str]]:
    """Names and texts: the notices above and the whole license texts."""
    return [*TEMPLATES, *((f"{p.stem}-whole", p.read_text(encoding="utf-8")) for p in sorted(WHOLE_TEXTS.glob("*.txt")))]


def shingle_rows(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """`keep`, pos and s (hash) for each 5-word shingle."""
    at = F.posexplode(F.slice(words, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))))
    each = rows.select(*keep, words, at.alias("pos", "w0"))
    return each.select(*keep, "pos", F.xxhash64("w0", *[F.element_at(words, F.col("pos") + k + 1) for k in range(1, SHINGLE)]).alias("s"))


def shingles_of(words: Column) -> Column:
    """The same hashes as an array; `words` has at least 5."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(SHINGLE)]))


def least_hashes(shingles: Column) -> Column:
    """The MinHash of each band over an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))


def template_shingles(given: DataFrame) -> DataFrame:
    """name, s, n (distinct shingles of the template) and m, its class; stored. Templates are given as name and text."""
    words = given.select("name", words_of(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    each = shingle_rows(words, "w", "name").select("name", "s").distinct()
    sizes = each.groupBy("name").agg(F.count("*").alias("n"))
    return stored(each.join(sizes, "name").withColumn("m", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")), "templates")


def retrieved(docs: DataFrame, near: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b, name): templates that meet a window of a text in a band; `near` has the template shingles of the texts."""
    classes = shingles.groupBy("m").agg(F.ceil(CONTAINMENT * F.min("n")).alias("least"))
    of_class = shingles.select("s", "m").distinct()
    begins = F.explode(F.array(*[F.floor(F.col("pos") / F.col("m")) - d for d in range(3)]))
    windows = near.join(bounded(of_class), "s").select("a", "b", "m", "s", begins.alias("win")).where("win >= 0")
    held = windows.groupBy("a", "b", "m", "win").agg(F.countDistinct("s").alias("hits")).join(F.broadcast(classes), "m")  # a row a power of two
    held = stored(held.where(F.col("hits") >= F.col("least")).select("a", "b", "m", "win"), "windows")
    rows = docs.select("text", *row_keys()).join(bounded(held.select("a", "b").distinct()), ["a", "b"], "left_semi")
    texts = rows.dropDuplicates(["a", "b"]).select("a", "b", words_of(F.col("text")).alias("w"))
    part = F.slice("w", (F.col("win") * F.col("m") + 1).cast("int"), F.col("m") * 3 + (SHINGLE - 1))
    met = texts.join(held, ["a", "b"]).select("a", "b", "m", part.alias("part"))
    lows = met.select("a", "b", "m", F.posexplode(least_hashes(shingles_of(F.col("part")))).alias("band", "low"))
    own = shingles.groupBy("name", "m").agg(F.collect_list("s").alias("all"))  # one template's
    bands = stored(own.select("name", "m", F.posexplode(least_hashes(F.col("all"))).alias("band", "low")), "bands")
    return lows.join(bounded(bands), ["m", "band", "low"]).select("a", "b", "name").distinct()


def best_stretches(hits: DataFrame) -> DataFrame:
    """a, b, name, containment, first_word from the places (pos) of a template's shingles (s) in a text, with n and m."""
    key = ["a", "b", "name"]
    before = F.coalesce(F.lag("pos").over(Window.partitionBy(*key, "s").orderBy("pos")), F.lit(-1))
    # a shingle counts in the stretches that begin after its last place, at most 2m before this one
    since = hits.select(*key, "n", "pos", (F.greatest(before, F.col("pos") - 2 * F.col("m")) + 1).alias("since"))
    steps = since.select(*key, "n", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("d")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(*key, "n", "x.at").agg(F.sum("x.d").alias("d"))
    counted = steps.withColumn("c", F.sum("d").over(Window.partitionBy(*key).orderBy("at")))
    best = counted.groupBy(*key, "n").agg(F.min(F.struct((-F.col("c")).alias("less"), "at")).alias("x")).select(*key, "n", (-F.col("x.less")).alias("c"), "x.at")
    best = best.where(F.col("c") >= CONTAINMENT * F.col("n"))
    first = hits.select(*key, "pos").join(best, key).where("pos >= at").groupBy(*key, "n", "c").agg(F.min("pos").cast("long").alias("first_word"))
    return first.select(*key, (F.col("c") / F.col("n")).alias("containment"), "first_word")


@cleaned
def scanned(docs: DataFrame, given: DataFrame) -> DataFrame:
    """doc_id, license, containment and first_word for each template (name, text) that a row of `docs` has."""
    docs = docs.select("doc_id", "text")
    shingles = template_shingles(given)
    vocabulary = stored(shingles.select("s").distinct(), "vocabulary")
    rows = docs.select(*row_keys(), words_of(F.col("text")).alias("w"))
    near = stored(shingle_rows(rows, "w", "a", "b").join(bounded(vocabulary), "s", "left_semi").select("a", "b", "pos", "s"), "near").distinct()
    asked = stored(retrieved(docs, near, shingles), "retrieved")
    hits = near.join(bounded(shingles), "s").join(bounded(asked), ["a", "b", "name"], "left_semi")
    best = stored(best_stretches(hits), "best")
    return docs.select("doc_id", *row_keys()).join(bounded(best), ["a", "b"]).select("doc_id", F.col("name").alias("license"), "containment", "first_word")


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(templates(), "name string, text string")


ORACLE = (
    r"""
WITH given(name, text) AS (VALUES """
    + ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates())
    + r"""),
tw AS (SELECT name, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM given),
ts AS (SELECT DISTINCT name, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tn AS (SELECT name, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS m FROM ts GROUP BY name),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
near AS (
  SELECT rid, i - 1 AS pos, name, n, m, g.s FROM (
    SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)) g
  JOIN ts USING (s) JOIN tn USING (name)),
held AS (
  SELECT a.rid, a.name, a.n, a.pos, count(DISTINCT b.s) AS hits FROM near a JOIN near b ON a.rid = b.rid AND a.name = b.name AND b.pos >= a.pos AND b.pos < a.pos + 2 * a.m
  GROUP BY a.rid, a.name, a.n, a.pos HAVING count(DISTINCT b.s) >= 0.8 * a.n),
best AS (SELECT rid, name, min(struct_pack(less := -hits / n, pos := pos)) AS x FROM held GROUP BY rid, name)
SELECT doc_id, name AS license, -x.less AS containment, CAST(x.pos AS BIGINT) AS first_word FROM best JOIN docs USING (rid)
"""
)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"), template_table(spark))
