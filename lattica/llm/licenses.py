"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

DataFrame operations only. Every line of a text, every block of SPANS lines (notices are wrapped), and the text as a
whole, is a vector over words; common words of prose weigh nothing, so only units that hold a telling word of some
template can have a cosine over 0, and all of those are scored, blocks from the telling line they begin with. Weights
are from counts over all texts, and bounded, so that a notice scores alike however many other texts there are. An SPDX
tag says its licence itself. A file whose whole text is a licence, or whose name says so
and that holds a notice, is the licence file of its directory; a file without a notice of its own takes the licence of
the nearest directory above it that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, sized, table

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Notices by licence (public standard wordings; the operator takes any other table of id, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT + _AS_IS),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _BSD_3),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("proprietary", "Copyright. All rights reserved. Proprietary and confidential."),
)
#: Words of prose, which weigh nothing.
COMMON = tuple("a an and any are as at be by can either except for found free from has have in is it may met of on or other that the their they this to use used was will with without work you your file files information".split())
WORD = r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"
SPDX = r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Lines of a block, and the most that a word weighs (as one that stands in a thousandth of the texts).
SPANS, MOST = (2, 3, 4, 6, 8, 12, 16, 24), 6.9
NAMED = r"(?i)^(un)?(licen[cs]e|copying|notice|copyright)([._-].*)?$"


def terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*COMMON))


def squares(words: Column) -> Column:
    """The sum over the distinct words of the squares of their counts."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))

    return F.aggregate(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), start, step)["sum"]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, notice string")


def spans_of(blocks: DataFrame) -> DataFrame:
    """file_key, unit, t, span: the terms of the first 2 to 24 lines of blocks (file_key, unit, ls), as many as there are.
    No term goes over a line's end, so each line is cut once and not once a span."""
    worded = blocks.select("file_key", "unit", F.transform("ls", terms).alias("ts"))
    spans = [F.when(F.size("ts") >= k, F.struct(F.lit(k).alias("span"), F.flatten(F.slice("ts", 1, k)).alias("t"))) for k in SPANS]
    return worded.select("file_key", "unit", F.explode(F.array_compact(F.array(*spans))).alias("s")).select("file_key", "unit", "s.t", "s.span")


def scan(files: DataFrame, templates: DataFrame, least: float = 0.7) -> DataFrame:
    """file_key, unit (first line from 0, or -1: the whole text), license, cosine: of each unit that reaches least, its best
    template. files: file_key (long), text. Null and empty texts have no units. Ties go to the smaller licence id."""
    spark = files.sparkSession
    shapes = templates.select("license", terms(F.col("notice")).alias("t")).distinct().withColumn("template", F.monotonically_increasing_id())
    shapes = table(shapes.where(F.size("t") > 0), "templates")
    vocabulary = [r[0] for r in shapes.select(F.explode("t").alias("w")).distinct().orderBy("w").collect()]
    cut = files.select("file_key", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    starts = F.transform(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.struct(i.alias("unit"), F.slice("ls", i + 1, max(SPANS)).alias("ls")))
    lines = cut.select("file_key", F.explode(starts).alias("s")).select("file_key", "s.unit", "s.ls", terms(F.element_at("s.ls", 1)).alias("t"))
    telling = lambda w: w.isin(*vocabulary)
    blocks = table(lines.where(F.exists("t", telling)).select("file_key", "unit", "ls"), "telling")
    some = blocks.select("file_key", "unit", terms(F.element_at("ls", 1)).alias("t"), F.lit(1).alias("span"))
    wide = spans_of(blocks)
    # where more distinct words stand outside the templates than this, no cosine reaches least
    inside = F.size(F.filter("t", telling))
    room = inside * inside * F.lit((1 / least**2 - 1) if least > 0 else float("inf"))
    wide = wide.where(F.size(F.array_distinct(F.filter("t", lambda w: ~telling(w)))) <= room)
    n = max(1, files.count())
    counted = some.select("file_key", F.explode(F.array_distinct("t")).alias("w")).where(F.col("w").isin(*vocabulary)).distinct().groupBy("w").agg(F.count("*").alias("df"))
    # a term outside the templates weighs as one that stands in a single text, up to the bound
    rare = F.least(F.log(F.lit(1.0 + n)) + 0.1, F.lit(MOST))
    idf = {r[0]: r[1] for r in counted.collect()}
    weights = spark.createDataFrame([(w, float(idf.get(w, 0))) for w in vocabulary] or [("", 0.0)], "w string, df double").select("w", F.least(F.log(F.lit(1.0 + n)) - F.log(1 + F.col("df") / 2) + 0.1, F.lit(MOST)).alias("idf"))
    bag = lambda df, *keys: df.select(*keys, F.explode("t").alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("tf"))
    weigh = lambda df: df.join(F.broadcast(weights), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", rare))
    of_template = weigh(bag(shapes, "license", "template"))
    norms = of_template.groupBy("template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    sides = F.broadcast(of_template.join(norms, "template").select("license", "template", "w", (F.col("x") / F.col("norm")).alias("y")))
    whole_keys = some.select("file_key").distinct()
    whole = files.select("file_key", "text").join(sized(whole_keys), "file_key", "left_semi").select("file_key", F.lit(-1).alias("unit"), terms(F.col("text")).alias("t"), F.lit(0).alias("span"))
    # words outside the templates all weigh the same, so of them the sum of squared counts is enough; the empty word
    # counts how often a unit stands in the input
    parts = some.unionByName(wide).unionByName(whole)
    parts = parts.select("file_key", "unit", "span", F.array_append(F.filter("t", telling), F.lit("")).alias("t"), squares(F.filter("t", lambda w: ~telling(w))).alias("outside"))
    units = weigh(table(bag(parts, "file_key", "unit", "span", "outside"), "units", "zstd"))
    copies = F.max(F.when(F.col("w") == "", F.col("tf")))
    known = F.sum(F.when(F.col("w") != "", F.col("x") * F.col("x")).otherwise(0.0))
    sums = units.groupBy("file_key", "unit", "span").agg(F.sqrt(known + copies * copies * rare * rare * F.max("outside")).alias("norm"))
    dots = units.join(sides, "w").groupBy("file_key", "unit", "span", "license", "template").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(sums, ["file_key", "unit", "span"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least).select("file_key", "unit", "license", "cosine")
    tagged = files.where(F.instr("text", "SPDX-License-Identifier:") > 0).select("file_key", F.posexplode(F.split("text", "\n")).alias("unit", "line"))
    tagged = tagged.select("file_key", "unit", F.regexp_extract("line", SPDX, 1).alias("license"), F.lit(1.0).alias("cosine")).where("license != ''")
    scored = scored.unionByName(tagged)
    best = scored.groupBy("file_key", "unit").agg(F.max(F.struct("cosine", "license")).alias("top"), F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("low"))
    return best.select("file_key", "unit", F.col("low.license").alias("license"), (-F.col("low.c")).alias("cosine"))


def label_files(files: DataFrame, templates: DataFrame, least: float = 0.7) -> DataFrame:
    """files (path, text; other columns stay) with own_license, license, license_from.

    own_license: the best notice of the file itself (null: none). license: that, else the licence of the nearest
    directory above that has a licence file; license_from: 'file', that directory's path, or null. A null path is a
    file in the root, ''. Rows that repeat are each labelled; columns with these names are replaced.
    """
    files = files.drop("own_license", "license", "license_from")
    names = {n: fresh(files, n) for n in ("_key", "_of", "_whole", "_dir", "_name", "_at", "_inherited", "_d", "_from")}
    key, of, whole, dir_, name, at, inherited, d, came = names.values()
    path = F.regexp_replace(F.coalesce("path", F.lit("")), "/+", "/")
    keyed = files.withColumn(key, F.xxhash64("path", "text"))
    found = table(scan(keyed.select(F.col(key).alias("file_key"), "text"), templates, least), "notices")
    own = found.groupBy("file_key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.max(F.col("unit") < 0).alias(whole))
    own = own.select(F.col("file_key").alias(of), F.col("b.license").alias("own_license"), whole)
    # bare directories: '' is the root
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    labelled = keyed.join(sized(own), F.col(key) == F.col(of), "left").withColumn(dir_, folder).withColumn(name, F.regexp_extract(path, "[^/]*$", 0))
    is_file = F.col("own_license").isNotNull() & (F.coalesce(whole, F.lit(False)) | F.col(name).rlike(NAMED))
    licences = labelled.where(is_file).groupBy(F.col(dir_).alias(at)).agg(F.min("own_license").alias(inherited))
    licences = table(licences, "licence_files")
    depth = F.size(F.split(dir_, "/"))
    above = F.concat(F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split(dir_, "/"), 1, i), "/")), F.array(F.lit("")))
    folders = labelled.select(dir_).distinct().select(dir_, F.explode(F.array_distinct(above)).alias(at))
    nearest = folders.join(sized(licences), at).groupBy(dir_).agg(F.max(F.struct(F.length(at).alias("n"), F.col(at).alias("a"), F.col(inherited).alias("i"))).alias("up"))
    nearest = nearest.select(F.col(dir_).alias(d), F.col("up.a").alias(came), F.col("up.i").alias(inherited))
    out = labelled.join(sized(nearest), F.col(dir_) == F.col(d), "left")
    return out.select(
        *files.columns, "own_license", F.coalesce("own_license", inherited).alias("license"),
        F.when(F.col("own_license").isNotNull(), "file").otherwise(F.col(came)).alias("license_from"),
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, each a file source/lang/doc_id: doc_id, own_license, license, license_from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return label_files(files, template_table(spark)).select("doc_id", "own_license", "license", "license_from")
