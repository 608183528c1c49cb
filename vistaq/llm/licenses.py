"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

SHINGLE, CONTAINED = 3, 0.8
#: A window that holds a template whole or CONTAINED of it meets it in some band with this probability or more.
SURE = 0.9999

#: Whole bodies of short public licenses.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Notices and opening sentences of public licenses, and bodies. Longer ones come from files, see template_files.
TEMPLATES = (
    ("MIT", _MIT), ("BSD-2-Clause", f"{_BSD_2}\n{_BSD_END}"), ("BSD-3-Clause", f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}"), ("ISC", _ISC), ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)


def words(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that is computed once a row: a generator, which the optimizer doesn't copy into what uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_shingles(df: DataFrame, text: str, name: str, size: int = SHINGLE) -> DataFrame:
    """df with a hash per run of size words of text; of fewer words, one for all of them; of none, none."""
    run = lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(size)))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_h") - size, F.lit(0))), run)
    hashed = once(df, "_h", F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    return once(hashed, name, F.when(F.size("_h") > 0, runs).otherwise(F.array().cast("array<bigint>"))).drop("_h")


def window_class(n: int) -> int:
    """The power of 2 from which a template of n shingles in a row, repeats counted, fits a window of twice as many, that begins at each multiple of it."""
    return max(4, 1 << (n - 1).bit_length())


def bands_for(n: int, contained: float = CONTAINED, sure: float = SURE, step: int | None = None) -> int:
    """Bands of one hash each by which a window of step, else of its class, and a template of n different shingles, contained of them there, meet with probability sure.

    With two thirds of the class's step as the least n, their Jaccard similarity is contained * n in 2 * step + n - contained * n.
    """
    step = step or window_class(n)
    j = contained * n / (2 * step + (1 - contained) * n)
    return math.ceil(math.log(1 - sure) / math.log(1 - j))


def sketch(hashes: str, bands: Column) -> Column:
    """Per band the least of the permuted hashes, and the hash that it comes from."""
    one = lambda k: lambda h: F.struct(F.xxhash64(h, k).alias("least"), h.alias("at"))
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.array_min(F.transform(hashes, one(k))))


def template_table(spark: SparkSession, templates=TEMPLATES, contained: float = CONTAINED) -> tuple[DataFrame, dict[int, int]]:
    """Rows (license, template, shingles, n, step, family, telling, kin) and the bands of each step. Its size is that of the templates.

    Templates of which one holds half of the other's shingles, or a chain of such, are a family: wordings that differ in a version or a name.
    telling are, by template of another license in the family, the shingles that this one has and that one hasn't; kin are
    the family's licenses.
    """
    rows = [(a, i, t) for i, (a, t) in enumerate(templates)]
    t = with_shingles(spark.createDataFrame(rows, "license string, template int, body string"), "body", "shingles")
    got = t.select("license", "template", F.array_distinct("shingles").alias("shingles"), F.size("shingles").alias("length")).collect()
    bands: dict[int, int] = {}
    rows, family = [], list(range(len(got)))
    for i, a in enumerate(got):
        for j, b in enumerate(got[:i]):
            if 2 * len({*a["shingles"]} & {*b["shingles"]}) >= min(len(a["shingles"]), len(b["shingles"])):
                family = [family[j] if f == family[i] else f for f in family]
    for r in got:
        n = len(r["shingles"])
        step = window_class(r["length"])  # so that one window holds all of the passage
        bands[step] = max(bands.get(step, 0), bands_for(n, contained, step=step))
        mine = family[len(rows)]
        apart = [[h for h in r["shingles"] if h not in o["shingles"]] for f, o in zip(family, got, strict=True) if f == mine and o["license"] != r["license"]]
        kin = sorted({o["license"] for f, o in zip(family, got, strict=True) if f == mine})
        rows.append((r["license"], r["template"], r["shingles"], n, step, mine, [hs for hs in apart if hs], ", ".join(kin) if len(kin) > 1 else None))
    return spark.createDataFrame(rows, "license string, template int, shingles array<bigint>, n int, step int, family int, telling array<array<bigint>>, kin string"), bands


def template_files(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """Templates of a folder of license files, named by license: whole bodies, few and of a size that the driver holds. They are given to scan_licenses beside TEMPLATES."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return tuple(sorted((r["name"].removesuffix(".txt"), r["value"]) for r in files))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """A row per document row and license found: doc_id, license, family, told_apart, best, template, first_word, containment, windows.

    Each text is cut into windows of 2 * step shingles at every multiple of step, for each step that templates need, so a
    template's passage lies whole in one. A window meets a template if they share the least hash of one band; of the
    templates met, those are found of whose shingles contained or more are in the window. All are returned. Relatives,
    wordings that differ in a version or a name, are often contained in one another's passages: family lists the
    licenses of the family (null if there is one), told_apart says whether shingles were found that tell the template from
    each one of another license in it, and best whether no other of the family is contained more thereabouts.

    Windows that hold no shingle in which any template is least in a band can't meet one, and are left out before their own
    least hashes are taken. first_word is where the best window begins. Null and empty texts and such without a template
    give no row; finds of one row are merged by document, so rows that repeat id and text come once. Only the templates are
    broadcast.
    """
    spark = docs.sparkSession
    table, bands = template_table(spark, templates, contained)
    steps = F.array(*(F.struct(F.lit(step).alias("step"), F.lit(n).alias("bands")) for step, n in sorted(bands.items())))
    own = F.create_map(*(F.lit(x) for kv in bands.items() for x in kv))[F.col("step")]
    keys = table.select("template", "step", F.posexplode(sketch("shingles", own)).alias("band", "_k")).select("template", "step", "band", "_k.*").collect()  # of the templates
    signs = sorted({r["at"] for r in keys})
    keys = spark.createDataFrame([(r["template"], r["step"], r["band"], r["least"]) for r in keys], "template int, step int, band int, least long")
    known = lambda h: h.isin(*signs)

    texts = with_shingles(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), "text"), "text", "_s").drop("text")
    texts = texts.where(F.exists("_s", known))
    begins = F.flatten(F.transform(steps, lambda st: F.transform(F.sequence(F.lit(0), F.size("_s") - 1, st.step), lambda b: F.struct(st.step.alias("step"), st.bands.alias("bands"), b.alias("begin")))))
    windows = texts.select("doc_id", "_row", "_s", F.explode(begins).alias("_b")).select("doc_id", "_row", "_b.*", F.slice("_s", F.col("_b.begin") + 1, 2 * F.col("_b.step")).alias("_w"))
    windows = windows.where(F.exists("_w", known))
    met = windows.select("*", F.posexplode(sketch("_w", F.col("bands"))).alias("band", "_k")).select("*", F.col("_k.least").alias("least")).drop("_k")
    met = met.join(F.broadcast(keys), ["step", "band", "least"]).join(F.broadcast(table.drop("step")), "template")
    part = F.size(F.array_intersect("_w", "shingles")) / F.col("n")
    told = F.forall("telling", lambda hs: F.arrays_overlap(hs, F.col("_w")))
    found = met.select("doc_id", "_row", "begin", "license", "template", "family", "kin", told.alias("told"), part.alias("containment")).where(F.col("containment") >= contained).distinct()
    near = Window.partitionBy("doc_id", "_row", "family").orderBy("begin").rangeBetween(-2 * max(bands), 2 * max(bands))  # the finds of one document
    found = found.withColumn("_best", F.col("containment") == F.max("containment").over(near))
    best = F.max(F.struct("_best", "told", F.col("containment").alias("c"), (-F.col("begin")).alias("b"), (-F.col("template")).alias("t")))
    out = found.groupBy("doc_id", "_row", "license").agg(best.alias("m"), F.first("kin").alias("family"), F.bool_or("told").alias("told_apart"), F.countDistinct("begin").alias("windows"))
    return out.select("doc_id", "license", "family", "told_apart", F.col("m._best").alias("best"), (-F.col("m.t")).alias("template"), (-F.col("m.b")).cast("long").alias("first_word"), F.round("m.c", 6).alias("containment"), "windows")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
