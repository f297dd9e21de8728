"""License scans by MinHash bands over overlapping windows, with DataFrame functions alone.

A text is a sequence of five-word shingles.  Windows of ``SPAN`` shingles start at every ``STRIDE``-th; each has
``BANDS`` min-hashes (one row a band), each under a hash function of its own.  A template's windows start at every
shingle.  A text window that shares a band with a template retrieves it; the template is reported if the text
around that window contains at least 0.8 of the template's shingles.

A copy of a template of SPAN shingles or more meets one of its own windows at most STRIDE / 2 shingles off, that
is with a Jaccard similarity of 0.6 at least, and then on either side: the chance that no band of the two agrees is
under 0.4 ** 12, below 1 in 50,000.  With a word in ten changed, a longer template still has a window of similarity
0.4 or more every few shingles, which one window misses with a chance of 0.6 ** 6 = 0.05.  Templates
shorter than a window use windows of one shingle, whose min-hash is the shingle: they always collide.

Templates are a table of any size.  Their bands are joined with those of the texts, which are made and met within
a scan: broadcast while their counted rows are few, joined by shuffle above.  What is retrieved is verified
for texts that have a hit only.  Texts are known by a 128-bit hash, on which alone their matches depend.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsignal.llm.arrays import let
from quietsignal.llm.common import shared_checkpoints, table

WORDS, SPAN, STRIDE, BANDS, CONTAINED = 5, 8, 4, 6, 0.8
#: Rows (two longs each) up to which bands, templates and matches are broadcast, about 60 MB.
BROADCAST_ROWS = 2_000_000

#: Parts that two licenses share, in the words that their publishers give.
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Notices in the words that their publishers give.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_CONDITIONS} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_DISCLAIMER}"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def shingles(text: Column) -> Column:
    """Hash of every five successive words; words are runs of a-z and 0-9 after lower-casing.  Null counts as empty."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))
    return let(words, lambda w: F.when(F.size(w) >= WORDS, each(w)).otherwise(F.expr("CAST(array() AS array<bigint>)")))


def bands(s: Column, stride: int) -> Column:
    """BANDS values for each window; those at the end of the text may be shorter."""
    under = lambda k: F.transform(s, lambda x: F.xxhash64(x, F.lit(k))).alias(f"h{k}")
    hashed = F.struct(*map(under, range(BANDS)))
    each = lambda h: F.flatten(F.transform(F.sequence(F.lit(1), F.size(s), F.lit(stride)), lambda i: F.array(*[F.array_min(F.slice(h[f"h{k}"], i, SPAN)) for k in range(BANDS)])))
    return F.when(F.size(s) > 0, let(hashed, each)).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def prepared(spark: SparkSession, templates: DataFrame | list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates (template, license, n, own: distinct shingles), the values that retrieve them (value, template, n),
    and all their shingles (value).

    Repeated templates count once; those of fewer than five words are left out, and so are null names and texts.
    """
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(templates, "license string, text string")
    rows = templates.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL").distinct()
    known = rows.select(F.xxhash64("license", "text").alias("template"), "license", shingles(F.col("text")).alias("s")).where(F.size("s") > 0)
    known = known.select("template", "license", F.size("s").alias("n"), "s", F.array_distinct("s").alias("own")).checkpoint()
    # A template's short windows at its end are none of its own; short templates go by single shingles.
    values = F.when(F.col("n") >= SPAN, F.slice(bands(F.col("s"), 1), F.lit(1), (F.col("n") - SPAN + 1) * BANDS)).otherwise(F.col("s"))
    return known.drop("s"), known.select("template", "n", F.explode(F.array_distinct(values)).alias("value")).checkpoint(), known.select(F.explode("own").alias("value")).distinct().checkpoint()


def small(frame: DataFrame) -> DataFrame:
    """``frame`` (checkpointed) for a join: broadcast only if its rows are few."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def scan(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] = TEMPLATES, least: float = CONTAINED, column: str = "matches") -> DataFrame:
    """``docs`` with ``column``: an array of (license, containment, first_word), best per license, by name.

    Null, empty and short texts have none, and so has every text if no template has five words.  A license with
    several templates counts with its best; of equal ones the first place counts.  Rows stay as they are, repeated
    ones too; a column of ``docs`` that has the name ``column`` is replaced, the others stay.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    known, values, every = prepared(spark, templates)
    k1, k2 = (F.xxhash64(*seed, F.coalesce("text", F.lit(""))) for seed in ((), (F.lit(7),)))
    key = ["__k1", "__k2"]
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), k1.alias("__k1"), k2.alias("__k2"))
    # A band that two windows share is the hash of a shingle that they share: texts without one need no bands.
    shared = texts.select(*key, F.explode(shingles(F.col("text"))).alias("value")).join(small(every), "value", "left_semi").select(key).distinct().checkpoint()
    both = let(shingles(F.col("text")), lambda s: let(bands(s, STRIDE), lambda b: F.struct(F.size(b).alias("w"), F.concat(b, s).alias("values"))))
    each = texts.join(small(shared), key, "left_semi").select(*key, both.alias("b")).select(*key, "b.w", F.posexplode("b.values").alias("pos", "value"))
    met = each.join(small(values), "value")
    # Values of windows retrieve long templates, single shingles short ones.
    at = F.when(F.col("pos") < F.col("w"), F.floor(F.col("pos") / BANDS) * STRIDE + 1).otherwise(F.col("pos") - F.col("w") + 1).cast("int")
    met = met.where((F.col("pos") < F.col("w")) == (F.col("n") >= SPAN)).select(*key, "template", "n", at.alias("at"))
    # A copy is longer than half of its template, so the first and last hit of each half show all that others do.
    spots = met.groupBy(*key, "template", "n", F.floor(F.col("at") * 2 / F.col("n")).alias("half")).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    asked = spots.groupBy(key).agg(F.flatten(F.collect_list(F.transform(F.array_distinct(F.array("a", "b")), lambda p: F.struct("template", "n", p.alias("at"))))).alias("asked")).checkpoint()

    def around(s: Column) -> Column:
        begin = lambda c: F.greatest(c["at"] - c["n"], F.lit(1))
        return F.transform("asked", lambda c: F.struct(c["template"].alias("template"), begin(c).alias("begin"), F.slice(s, begin(c), 2 * c["n"] + SPAN).alias("around")))

    looked = texts.join(small(asked), key).select(*key, F.explode(let(shingles(F.col("text")), around)).alias("c")).select(*key, "c.*").join(small(known), "template")
    common = let(F.array_intersect("around", "own"), lambda c: F.struct((F.size(c) / F.size("own")).alias("containment"), (-(F.col("begin") + F.array_position("around", F.get(c, F.lit(0))) - 2)).cast("int").alias("back")))
    best = looked.select(*key, "license", common.alias("m")).where(F.col("m.containment") >= least).groupBy(*key, "license").agg(F.max("m").alias("m"))
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("license", F.col("m.containment").alias("containment"), (-F.col("m.back")).alias("first_word")))).alias("__matches")).checkpoint()
    out = docs.withColumn("__k1", k1).withColumn("__k2", k2).join(small(listed), key, "left")
    none = F.expr("CAST(array() AS array<struct<license:string,containment:double,first_word:int>>)")
    return out.withColumn(column, F.coalesce("__matches", none)).drop(*key, "__matches")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("matches").alias("m")).select(
        "doc_id",
        F.size("m").cast("long").alias("n_licenses"),
        F.array_join(F.transform("m", lambda x: x["license"]), ",").alias("licenses"),
        F.array_max(F.transform("m", lambda x: x["containment"])).alias("containment"),
        F.array_join(F.transform("m", lambda x: x["first_word"].cast("string")), ",").alias("first_words"),
    )
