"""License scans: MinHash bands over text windows, then shingle containment. DataFrame functions only.

A text is normalised to lower-case words of letters and digits and cut into windows of six words, two words on
from each other, so each window holds two five-word shingles and each shingle lies in one window. Templates are
cut into all their runs of one and two shingles. A window that holds a template shingle therefore has a Jaccard
similarity of at least 1/2 with one of the template's runs; with 14 bands of one row each it shares a band with
probability 1 - 2^-14 at least. Only windows of which a shingle is set in a Bloom filter of all template shingles are
banded; the others could not count. Retrieved windows count for a template only by shingles that are its own, and a
text matches a template when it holds at least 0.8 of the template's distinct shingles, and all of those that tell
versions and kinds apart (EXACT). A template of fewer than five words counts as one shingle, found where its words stand.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm.common import counted

SHINGLE, WINDOW, BANDS, CONTAINED = 5, 2, 14, 0.8
#: Most distinct shingles of all templates together for which a bitmap is compiled into the filter; beyond it all windows
#: are banded, which costs time and disk but no match.
MOST_TEMPLATE_SHINGLES = 20_000
BITMAP = 1 << 20
#: Parts of a hash (shifts) that are set in the bitmap, each on its own. With one, a window in 25 passed by chance and was
#: written out 14 times; with three, one in some thousands.
PROBES = (0, 20, 40)
#: Shingles that a text must hold without exception; in templates of up to NOTICE words, any with a digit also.
EXACT, NOTICE = "(^| )((version|v) ?[0-9]|gnu general|lesser|affero|sharealike|noncommercial|noderivatives)", 25

#: Common public license notices, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("BSD-clauses", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


#: Names that notices put after "licensed under", by SPDX identifier.
NAMES = {
    "MIT": ["the MIT License", "an MIT License", "MIT"],
    "ISC": ["the ISC License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License"],
    "BSD": ["the BSD License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0"],
    **{
        f"{short}-{v}": [f"the GNU {name}, version {v}", f"the GNU {name} v{v}", f"the GNU {short} version {v}", f"the GNU {short} v{v}", f"the {short} version {v}", f"the {short} v{v}", f"the {short}v{v}", f"{short}-{v}", f"{short}v{v}"]
        for short, name, v in [
            ("GPL", "General Public License", "2"), ("GPL", "General Public License", "3"), ("LGPL", "Lesser General Public License", "2.1"),
            ("LGPL", "Lesser General Public License", "3"), ("AGPL", "Affero General Public License", "3"),
        ]
    },
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v2.0"],
    **{
        f"CC-{short}-{v}": [f"CC {short} {v}", *[f"{the} Creative Commons {name} {v} {place} License" for the in ("a", "the")]]
        for short, name in [
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        ]
        for v, place in [("3.0", "Unported"), ("4.0", "International")]
    },
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
}
VERBS = ["licensed", "released", "distributed", "available", "provided", "published"]
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Headers that go into each file, and the short lines.
HEADERS = [
    ("Apache-2.0-file-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 " + NOTICES[1][1] + " See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-header", _GNU.format("General Public License", "2")),
    ("GPL-3.0-header", _GNU.format("General Public License", "3")),
    ("LGPL-2.1-header", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0-header", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0-header", _GNU.format("Affero General Public License", "3")),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("All-rights-reserved", "All rights reserved."),
]


def template_set() -> list[tuple[str, str]]:
    """NOTICES, "licensed under" notices and SPDX lines of NAMES, HEADERS, and the whole texts in license_texts; equal words once."""
    made = [(f"{i}-{verb}-{k}", f"{verb} under {name}") for i, names in NAMES.items() for verb in VERBS for k, name in enumerate(names)]
    made += [(f"{i}-spdx", f"SPDX-License-Identifier: {j}") for i in NAMES if i != "BSD" for j in [f"{i}.0" if re.search("GPL-[23]$", i) else i]]
    whole = [(f"{p.name.removesuffix('.txt')}-text", p.read_text(encoding="utf-8")) for p in sorted(files("lamplight.llm").joinpath("license_texts").iterdir(), key=lambda p: p.name)]
    kept: dict[str, tuple[str, str]] = {}
    for i, text in [*NOTICES, *HEADERS, *made, *whole]:
        kept.setdefault(re.sub(r"[\W_]+", " ", text.lower()).strip(), (i, text))
    return list(kept.values())


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_set(), "template_id string, text string")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _words(text: Column) -> Column:
    return F.split(_plain(text), " ")


def _shingles(words: str) -> Column:
    """Hashes of the five-word shingles of the array column; none for fewer words."""
    last = SHINGLE - 1
    parts = ", ".join(f"{words}[i + {j}]" for j in range(SHINGLE))
    return F.expr(f"CASE WHEN size({words}) > {last} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({parts})) ELSE array() END").cast("array<bigint>")


def _grams(words: list[str]) -> list[tuple[str, bool]]:
    """The shingles of a template in order, and whether a text must hold them; fewer than five words are one shingle."""
    if len(words) < SHINGLE:
        return [(" ".join(words), True)] if words[0] else []
    said = [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    return [(g, bool(re.search(EXACT, g) or len(words) <= NOTICE and re.search("[0-9]", g))) for g in said]


def _bitmap(hashes: list[int]) -> str:
    """SQL for an array of 64-bit words with the bit of each probe of each hash set."""
    longs = [0] * (BITMAP // 64)
    for h in hashes:
        for probe in PROBES:
            at = (h >> probe) & (BITMAP - 1)
            longs[at >> 6] |= 1 << (at & 63)
    return "CAST(split('" + ",".join(str(x - (1 << 64) if x >> 63 else x) for x in longs) + "', ',') AS array<bigint>)"


def _in_bitmap(bits: str, h: str) -> str:
    """SQL for whether all probes of a hash are set; mostly the first says no."""
    probed = (f"shiftright({h}, {probe})" for probe in PROBES)
    return "(" + " AND ".join(f"(shiftright({bits}[CAST(shiftright({p} & {BITMAP - 1}, 6) AS INT)], CAST({p} & 63 AS INT)) & 1) = 1" for p in probed) + ")"


def _suspected(windows: DataFrame, hashes: list[int]) -> DataFrame:
    """Windows (a, b, ...) of which a shingle may be one of the hashes; none that is goes."""
    if len(hashes) > MOST_TEMPLATE_SHINGLES:
        return windows
    bits = _bitmap(hashes)
    return windows.filter(F.expr(_in_bitmap(bits, "a") + " OR " + _in_bitmap(bits, "b")))


def _short_places(words: str, said: str, h: int) -> str:
    """SQL for the windows of one short template: every place where its words stand."""
    n = said.count(" ") + 1
    found = f"transform(filter(sequence(0, size({words}) - {n}), i -> array_join(slice({words}, i + 1, {n}), ' ') = '{said}'), i -> struct(i AS at, {h}L AS a, {h}L AS b))"
    return f"CASE WHEN contains(concat(' ', plain, ' '), ' {said} ') THEN {found} ELSE array() END"


def _band(values: list[Column], j: int) -> Column:
    hashed = [F.xxhash64(v, F.lit(j)) for v in values]
    return reduce(F.least, hashed)


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template that it contains: doc_id, template_id, containment, n_found,
    n_template (distinct shingles of the template), first_shingle, last_shingle (positions in the text, from 0).

    Words are compared without case and punctuation. A null text counts as empty and matches nothing, as does an
    empty template. A template of fewer than five words is found as it stands, and counts as one shingle. Repeated rows are scanned each on its own and give a row each.
    Templates with equal words all match. An empty table gives no rows. Other columns are not read. Shingles are
    compared by their 64-bit hashes.
    """
    spark = docs.sparkSession
    templates = notices(spark) if templates is None else templates
    # so few rows that they go through the driver, once
    grams = [(i, *g) for i, w in templates.select("template_id", _words(F.col("text"))).collect() for g in _grams(w)]
    said = spark.createDataFrame(sorted({(said, *said.split(" "), *[None] * SHINGLE)[: SHINGLE + 1] for _, said, _ in grams}), ", ".join(["said string", *[f"w{j} string" for j in range(SHINGLE)]]))
    hashed_as = dict(said.select("said", F.when(F.col(f"w{SHINGLE - 1}").isNull(), F.xxhash64(F.lit("short"), "said")).otherwise(F.xxhash64(*[f"w{j}" for j in range(SHINGLE)]))).collect())
    by_template: dict[str, list[tuple[int, bool]]] = {}
    for i, text, must in grams:
        by_template.setdefault(i, []).append((hashed_as[text], must))
    held_by = [(i, [h for h, _ in g], dict(g)) for i, g in by_template.items()]
    own = spark.createDataFrame([(i, h, m, len(flags), sum(flags.values())) for i, _, flags in held_by for h, m in flags.items()], "template_id string, h long, must boolean, n_template long, n_must long")
    runs = spark.createDataFrame(sorted({(i, *run) for i, s, _ in held_by for run in [*zip(s, s, strict=True), *zip(s, s[1:], strict=False)]}), "template_id string, a long, b long")
    hashes = sorted(hashed_as.values())
    shorts = sorted((text, h) for text, h in hashed_as.items() if text.count(" ") < SHINGLE - 1)
    bands = F.array(*[F.struct(F.lit(j).alias("band"), _band([F.col("a"), F.col("b")], j).alias("value")) for j in range(BANDS)])
    wanted = runs.select("template_id", F.explode(bands).alias("x")).select("template_id", "x.band", "x.value").distinct()

    plain = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).cast("long").alias("doc_id"), _plain(F.col(text_col)).alias("plain"))
    texts = plain.withColumn("w", F.split("plain", " "))
    short = ", ".join(_short_places("w", said, h) for said, h in shorts)
    hashed = texts.select("_uid", "doc_id", _shingles("w").alias("s"), (F.expr(f"flatten(array({short}))") if shorts else F.expr("array()")).cast("array<struct<at:int,a:bigint,b:bigint>>").alias("short"))
    # a window is (place, its two shingles); at the end of a text the last may have one
    pairs = "CASE WHEN size(s) > 0 THEN transform(sequence(0, size(s) - 1, 2), i -> struct(i AS at, s[i] AS a, CASE WHEN i + 1 < size(s) THEN s[i + 1] ELSE s[i] END AS b)) ELSE array() END"
    windows = hashed.select("_uid", "doc_id", F.explode(F.concat(F.expr(pairs).cast("array<struct<at:int,a:bigint,b:bigint>>"), "short")).alias("x")).select("_uid", "doc_id", "x.at", "x.a", "x.b")
    banded = _suspected(windows, hashes).select("_uid", "doc_id", "at", "a", "b", F.explode(bands).alias("x")).select("_uid", "doc_id", "at", "a", "b", "x.band", "x.value")
    retrieved = banded.join(counted(wanted), ["band", "value"]).select("_uid", "doc_id", "at", "a", "b", "template_id").distinct()
    held = F.explode(F.array(F.struct(F.col("at").alias("at"), F.col("a").alias("h")), F.struct((F.col("at") + F.when(F.col("a") == F.col("b"), 0).otherwise(1)).alias("at"), F.col("b").alias("h"))))
    found = retrieved.select("_uid", "doc_id", "template_id", held.alias("x")).select("_uid", "doc_id", "template_id", "x.at", "x.h")
    checked = found.join(counted(own), ["template_id", "h"])
    matched = checked.groupBy("_uid", "doc_id", "template_id").agg(
        F.countDistinct("h").alias("n_found"), F.countDistinct(F.when(F.col("must"), F.col("h"))).alias("n_held"), F.max("n_template").alias("n_template"), F.max("n_must").alias("n_must"), F.min("at").alias("first_shingle"), F.max("at").alias("last_shingle")
    )
    return matched.withColumn("containment", F.col("n_found") / F.col("n_template")).filter((F.col("n_found") >= F.col("n_template") * CONTAINED) & (F.col("n_held") == F.col("n_must"))).select(
        "doc_id", "template_id", "containment", "n_found", "n_template", "first_shingle", "last_shingle"
    )
