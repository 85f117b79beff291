"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A header is a run of lines that name a licence term, with up to two other lines between them.  Its words
make a sparse TF-IDF vector, joined to the templates' vectors word by word; the template of the highest
cosine counts if it reaches the threshold.  A file whose licence headers hold at least half of its words
is a licence file: it governs its directory.  Files without a header of their own take the licence of
the nearest ancestor directory that has a licence file, found by joins on directory paths.

A header is compared as a whole, and so are its parts: runs of its lines and sentences without the copyright
lines.  A file is compared as a whole with full licence texts.  A whole file comes before parts, then the highest
cosine.  Only where no cosine reaches the threshold does a file take the licence that it states by name or SPDX tag.

All of it is DataFrame code.  The templates are a fixed list; only they are broadcast.

Defined cases: null and empty texts have no header and may inherit; ties of cosine go to the
template that comes first by name; of several licence files in a directory, the highest cosine governs,
then the first name; repeated rows are judged alike; null paths inherit nothing; an empty table gives no
row; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of, written

THRESHOLD = 0.7
#: Lines without a licence term that may stand inside a header.
GAP_LINES = 2
#: Share of a file's words in licence headers, in percent, from which it is a licence file.
FILE_PERCENT = 50
#: Lines without a licence term that may stand inside a region, whose parts are compared.
REGION_LINES = 8
#: Numbers of neighbouring pieces (lines or sentences) compared at once; runs of a size start a quarter of it apart.
RUNS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Cosine to a full text from which a whole file is that licence; two different full texts below stay under it,
#: but for versions of one licence, of which the nearest counts.
FULL_THRESHOLD = 0.9

TERMS = r"(?i)licen[cs]|copyright|\(c\) ?\d{4}|spdx|warrant|redistribut|public domain|permission"
#: Terms of the regions whose parts are compared: these and names of licences without one.
REGION_TERMS = TERMS + r"|\b[al]?gpl|creative commons|\bcc[ -](?:by|0)|under the terms of|unencumbered"
WORD = r"[a-z0-9]+(?:[.][0-9]+)*"

# Usual notices of public licences, (name, notice).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: Redistributions of source code must retain the above "
                     "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution. Neither the name of the "
                     "copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work. This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
                "(at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 3 of the License, or "
                 "(at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _gnu(program: str, licence: str, version: str, semicolon: str = ";") -> str:
    """The usual notice of a GNU licence, all three paragraphs."""
    return (f"This {program} is free software{semicolon} you can redistribute it and/or modify it under the terms of the "
            f"GNU {licence} as published by the Free Software Foundation; either version {version} of the License, or (at "
            f"your option) any later version. This {program} is distributed in the hope that it will be useful, but "
            f"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
            f"PURPOSE. See the GNU {licence} for more details. You should have received a copy of the GNU {licence} along "
            f"with this {program}. If not, see <https://www.gnu.org/licenses/>.")


_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
          "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
          "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
          "DEALINGS IN THE SOFTWARE.")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
              "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
              "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
              "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
              "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
              "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
              "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
              "DAMAGE.")
_BSD_2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
          "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
          "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
          "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
          "provided with the distribution.")
_NOTICE = {name: notice for name, notice in reversed(TEMPLATES)}  # the first, long one of each name

# More notices, among them whole texts of the short licences.
NOTICES: tuple[tuple[str, str], ...] = TEMPLATES + (
    ("AGPL-3.0", _gnu("program", "Affero General Public License", "3", ":")),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_NOTICE['BSD-3-Clause']} {_BSD_AS_IS}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "http://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *((f"GFDL-{v}", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                    f"Documentation License, Version {v} or any later version published by the Free Software Foundation; with "
                    "no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.") for v in ("1.2", "1.3")),
    ("GPL-1.0", _gnu("program", "General Public License", "1")),
    ("GPL-2.0", _gnu("program", "General Public License", "2")),
    ("GPL-3.0", _gnu("program", "General Public License", "3", ":")),
    ("ISC", f"{_NOTICE['ISC']} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
            "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
            "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.0", _gnu("library", "Library General Public License", "2")),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1")),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1").split(" This library is dist")[0]),
    ("LGPL-3.0", _gnu("library", "Lesser General Public License", "3")),
    ("MIT", f"{_NOTICE['MIT']} {_AS_IS}"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
                "use this file except in compliance with the License. You may obtain a copy of the License at "
                "http://www.mozilla.org/MPL/"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
             "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
             "to the following restrictions"),
)
# Names by which a header states its licence, in words as ``WORD`` cuts them.
NAMES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?v?3(?:[.]0)?"),
    ("Apache-2.0", "apache(?: software)?(?: license)?(?: version| v)? ?v?2(?:[.]0)?"),
    ("BSD-2-Clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("BSD-3-Clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("BSL-1.0", "boost software license(?: version)? 1[.]0"),
    ("CC-BY-4.0", "(?:cc by|creative commons attribution) 4[.]0"),
    ("CC-BY-NC-4.0", "(?:cc by nc|creative commons attribution noncommercial) 4[.]0"),
    ("CC-BY-SA-4.0", "(?:cc by sa|creative commons attribution sharealike) 4[.]0"),
    ("EPL-2.0", "eclipse public license(?: version| v)? ?v?2[.]0"),
    ("GPL-2.0", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?2(?:[.]0)?"),
    ("GPL-3.0", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?3(?:[.]0)?"),
    ("ISC", "isc license"),
    ("LGPL-2.1", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?2[.]1"),
    ("LGPL-3.0", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?3(?:[.]0)?"),
    ("MIT", "(?:mit|expat)(?: x11)?(?: license| licence)"),
    ("MPL-1.1", "mozilla public license(?: version| v)? ?v?1[.]1"),
    ("MPL-2.0", "(?:mozilla public license|mpl)(?: version| v)? ?v?2(?:[.]0)?"),
    ("Unlicense", "unlicense"),
    ("Zlib", "zlib license"),
)
DENIED = (r"\b(?:not|never|neither|nor|isn|wasn|aren|competitors?)((?: [a-z0-9]+){0,4}?) "
          r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed)\b")
STATED = (r"(?:^| )(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed)(?: [a-z]+){0,3}? "
          r"(?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?(?: gnu)? (?:NAME)(?: |$)")
_SPDX_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?\)*"
SPDX = rf"SPDX-License-Identifier:[ \t]*({_SPDX_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_SPDX_ID})*)"
COPYRIGHT = r"(?i)copyright|\(c\) ?\d{4}|all rights reserved"
OTHER_TERMS = r"(?i)licen[cs]|spdx|warrant|redistribut|public domain|permission|copyright notice"


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the whole texts at hand; the AGPL is the GPL under its own name."""
    texts = {f.stem: f.read_text("utf-8", "replace") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    texts["AGPL-3.0"] = (texts["GPL-3.0"].replace("GNU General Public", "GNU Affero General Public")
                         .replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC"))
    long = tuple((name, t) for name, t in NOTICES[len(TEMPLATES):] if name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT")
                 and "AS IS" in t)
    return tuple(sorted(texts.items())) + long


def template_rows(notices: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], float]:
    """([(template, name, word, weight of unit-length vector)], idf of words in no template)."""
    bags = []
    for _, notice in notices:
        bag: dict[str, int] = {}
        for w in re.findall(WORD, notice.lower()):
            bag[w] = bag.get(w, 0) + 1
        bags.append(bag)
    n = len(bags)
    df: dict[str, int] = {}
    for bag in bags:
        for w in bag:
            df[w] = df.get(w, 0) + 1
    rows = []
    for i, bag in enumerate(bags):
        weight = {w: c * math.log(1 + n / df[w]) for w, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rows += [(i, notices[i][0], w, x / norm) for w, x in sorted(weight.items())]
    return rows, math.log(1 + n)


def idf_rows(notices: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, float]]:
    n, df = len(notices), {}
    for _, notice in notices:
        for w in set(re.findall(WORD, notice.lower())):
            df[w] = df.get(w, 0) + 1
    return [(w, math.log(1 + n / c)) for w, c in sorted(df.items())]


def directory_of(path: Column) -> Column:
    """The part before the last slash; empty for the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def headers(docs: DataFrame, text: str = "t", gap: int = GAP_LINES, joint: str = " ", terms: str = TERMS) -> DataFrame:
    """row, block, header of every run of licence lines; ``docs`` has a row number ``row``."""
    lines = (docs.select("row", F.posexplode(F.split(text, "\n")).alias("at", "line"))
             .withColumn("hit", F.col("line").rlike(terms)))
    by_row = W.partitionBy("row").orderBy("at")
    last = F.last(F.when(F.col("hit"), F.col("at")), True).over(by_row)
    after = F.first(F.when(F.col("hit"), F.col("at")), True).over(by_row.rowsBetween(0, W.unboundedFollowing))
    inside = (lines.withColumn("last", last).withColumn("after", after)
              .filter("hit or after - last <= " + str(gap + 1)))
    starts = inside.withColumn("new", F.coalesce(
        (F.col("at") - F.lag("at").over(by_row) > 1).cast("int"), F.lit(1)))
    blocks = starts.withColumn("block", F.sum("new").over(by_row))
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return blocks.groupBy("row", "block").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), joint).alias("header"))


def windows(regions: DataFrame) -> DataFrame:
    """row, block, part, header, extra of the parts of each region; ``extra`` counts the words of its copyright lines."""
    pieces = F.filter(F.split("header", r"\n|(?<=[.!?])[ \t]+(?=[A-Z\"'(])"), lambda x: x.rlike(r"[A-Za-z0-9]"))
    cut = regions.select("row", "block", pieces.alias("all")).select(
        "row", "block", "all", F.filter("all", lambda x: ~x.rlike(COPYRIGHT) | x.rlike(OTHER_TERMS)).alias("p"))
    sized = cut.withColumn("n", F.size("p")).withColumn("extra", F.size(F.expr(
        f"regexp_extract_all(lower(array_join(array_except(all, p), ' ')), '{WORD}', 0)")))
    runs = F.expr("flatten(transform(filter(array(" + ", ".join(map(str, RUNS)) + "), s -> s <= n), s -> transform("
                  "array_union(sequence(0, n - s, greatest(1, s div 4)), array(n - s)), i -> struct(i, s))))")
    parts = sized.select("row", "block", "extra", "p", F.posexplode(runs).alias("part", "run"))
    joined = F.array_join(F.slice("p", F.col("run.i") + 1, F.col("run.s")), " ")
    return parts.select("row", "block", "part", "extra", joined.alias("header")).filter(F.col("header").rlike(REGION_TERMS))


def stated(regions: DataFrame) -> DataFrame:
    """row, block, licence, similarity, n_words of the licences that regions state by name or by SPDX tag."""
    bare = F.array_join(F.expr(f"regexp_extract_all(lower(header), '{WORD}', 0)"), " ")
    bare = F.regexp_replace(bare, DENIED, "denied$1")  # "never released under" states nothing

    def found(licence: Column, said: Column) -> Column:
        return F.struct(licence.alias("licence"), F.lit(1.0).alias("similarity"),
                        F.size(F.split(F.trim(said), "[^A-Za-z0-9.]+")).cast("long").alias("n_words"))

    names = F.array_compact(F.array(*(
        F.when(bare.rlike(p), found(F.lit(name), F.regexp_extract(bare, p, 0)))
        for name, p in ((n, STATED.replace("NAME", x)) for n, x in NAMES))))
    tags = F.transform(F.expr(f"regexp_extract_all(header, r'{SPDX}', 1)"),
                       lambda x: found(_spdx_name(x), F.concat(F.lit("SPDX-License-Identifier: "), x)))
    return regions.select("row", "block", F.explode(F.concat(names, tags)).alias("x")).select("row", "block", "x.*")


def _spdx_name(tag: Column) -> Column:
    """A tag's expression; a single name as the templates spell it."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(tag), r"[ \t]+", " "), r"(?i)^(\S*GPL-\S+|GFDL-\S+?)(?:-only|-or-later|[+])$", "$1")
    known = {n.lower(): n for n, _ in (*NOTICES, *NAMES, *full_texts())}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))[F.lower(tidy)], tidy)


def _fixed(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """The template tables as SQL values."""
    def lit(x):
        return f"{x!r}D" if isinstance(x, float) else repr(x)
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({columns})")


def _packed(spark: SparkSession, rows: list[tuple[int, str, str, float]]) -> DataFrame:
    """The template vectors, one SQL value each."""
    texts: dict[tuple[int, str], list[str]] = {}
    for template, licence, word, weight in rows:
        texts.setdefault((template, licence), []).append(f"{word} {weight!r}")
    packed = _fixed(spark, [(*k, ";".join(v)) for k, v in texts.items()], "template, licence, packed")
    pair = (packed.select("template", "licence", F.explode(F.split("packed", ";")).alias("pair"))
            .select("template", "licence", F.split("pair", " ").alias("p")))
    return pair.select("template", "licence", F.col("p")[0].alias("word"), F.col("p")[1].cast("double").alias("weight"))


def best_templates(blocks: DataFrame, keys: tuple[str, ...] = ("row", "block"), notices: tuple[tuple[str, str], ...] = NOTICES,
                   threshold: float = THRESHOLD) -> DataFrame:
    """keys, licence, similarity, n_words of the nearest template of each header that reaches the threshold."""
    spark = blocks.sparkSession
    rows, other = template_rows(notices)
    vectors = F.broadcast(_packed(spark, rows))
    idf = F.broadcast(_packed(spark, [(0, "", *r) for r in idf_rows(notices)]).select("word", F.col("weight").alias("idf")))
    words = (blocks.select(*keys, F.explode(F.expr(f"regexp_extract_all(lower(header), '{WORD}', 0)")).alias("word"))
             .groupBy(*keys, "word").count()
             .join(idf, "word", "left")
             .withColumn("w", F.col("count") * F.coalesce("idf", F.lit(other))))
    norms = words.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
                                     F.sum("count").alias("n_words"))
    dots = words.join(vectors, "word").groupBy(*keys, "template", "licence").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, list(keys)).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6))
    first = F.min_by(F.struct("licence", "similarity", "n_words"),
                     F.struct((-F.col("similarity")).alias("s"), F.col("licence"), F.col("template")))
    return (scored.filter(F.col("similarity") >= threshold).groupBy(*keys).agg(first.alias("best"))
            .select(*keys, "best.*"))


def best_parts(regions: DataFrame) -> DataFrame:
    """row, licence, similarity, n_words, said of each region's best part; of a statement (``said``) where no part counts."""
    parts = windows(regions)
    extra = parts.groupBy("row", "block").agg(F.max("extra").alias("extra"))
    near = (best_templates(parts, ("row", "block", "part")).join(extra, ["row", "block"])
            .select("row", "block", "licence", "similarity", (F.col("n_words") + F.col("extra")).alias("n_words")))
    order = F.struct("said", (-F.col("similarity")).alias("s"), F.col("licence"))
    best = F.min_by(F.struct("licence", "similarity", "said"), order)
    words = F.max_by("n_words", F.struct("similarity", "n_words"))
    both = near.withColumn("said", F.lit(False)).unionByName(stated(regions).withColumn("said", F.lit(True)))
    return both.groupBy("row", "block").agg(best.alias("best"), words.alias("n_words")).select("row", "best.*", "n_words")


def scan_licences(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per file: key, path, licence, similarity, via (header, file, directory or null), licence_dir."""
    # one pass over the texts: only those with a licence term can hold a header, and only they are kept
    numbered = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(path).alias("path"),
        F.when(text_of(text).rlike(REGION_TERMS), text_of(text)).alias("t")), "licence-texts")
    held_texts = numbered.filter("t is not null")
    regions = written(headers(held_texts, gap=REGION_LINES, joint="\n", terms=REGION_TERMS), "licence-regions")
    shape = ("row", "licence", "similarity", "n_words")
    found = written(
        best_templates(headers(held_texts)).select(*shape, F.lit(1).alias("by"))
        .unionByName(best_parts(regions).select(*shape, F.when(F.col("said"), 3).otherwise(2).alias("by")))
        .unionByName(best_templates(held_texts.select("row", F.col("t").alias("header")), ("row",), full_texts(), FULL_THRESHOLD)
                     .select(*shape, F.lit(0).alias("by"))), "licence-headers")
    by_words = [F.sum(F.when(F.least("by", F.lit(2)) == k, F.col("n_words"))) for k in range(3)]  # the same words may be found by each
    per_row = found.groupBy("row").agg(
        F.min_by(F.struct("licence", "similarity"), F.struct((F.col("by") > 0).alias("part"), (F.col("by") == 3).alias("said"),
                                                             (-F.col("similarity")).alias("s"), F.col("licence"))).alias("own"),
        F.greatest(*by_words).alias("licence_words"))
    size = F.expr(f"size(regexp_extract_all(lower(t), '{WORD}', 0))")
    files = numbered.select("row", "key", "path", F.when(F.col("t").isNotNull(), size).alias("n_words"))
    held = written(files.join(per_row, "row", "left").select(
        "key", "path", directory_of(F.col("path")).alias("dir"), "own.licence", "own.similarity",
        F.coalesce(100 * F.col("licence_words") >= FILE_PERCENT * F.col("n_words"), F.lit(False)).alias("is_file")),
        "licence-files")
    governing = held.filter("is_file and dir is not null").groupBy("dir").agg(
        F.min_by(F.struct("licence", "similarity"), F.struct((-F.col("similarity")).alias("s"), F.col("licence"))).alias("g"))
    # each directory once, with all its ancestors: paths are joined, not files
    parts = F.split("dir", "/")
    ups = (held.filter("dir is not null").select("dir").distinct()
           .withColumn("up", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)),
                                                   lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))))
    near = (ups.join(governing.withColumnRenamed("dir", "up"), "up")
            .groupBy("dir").agg(F.max_by(F.struct("up", "g"), F.length("up")).alias("near")))
    out = held.join(near, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        F.col("key").alias(key), F.col("path").alias("path"),
        F.when(own, F.col("licence")).otherwise(F.col("near.g.licence")).alias("licence"),
        F.when(own, F.col("similarity")).otherwise(F.col("near.g.similarity")).alias("similarity"),
        F.when(F.col("is_file"), "file").when(own, "header").when(F.col("near").isNotNull(), "directory").alias("via"),
        F.when(own, F.col("dir")).otherwise(F.col("near.up")).alias("licence_dir"))


#: The documents as files: the source is the top folder, the language and a hundred ids the next ones.
DOCUMENT_PATH = "concat('/', coalesce(source, ''), '/', coalesce(lang, ''), '/', doc_id div 100, '/', doc_id, '.txt')"


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, their own or inherited."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{DOCUMENT_PATH} as path")
    return scan_licences(docs, "path")


def _sql(rows: list[tuple]) -> str:
    def lit(x):
        return repr(x) if not isinstance(x, float) else f"cast({x!r} as double)"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_VECTORS, _OTHER = template_rows()
_LAST = "over (partition by rid order by pos rows between unbounded preceding and current row)"
_NEXT = "over (partition by rid order by pos rows between current row and unbounded following)"
OP10_SQL = rf"""
with f as (select row_number() over () as rid, doc_id, coalesce(text, '') as t,
                  '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || cast(doc_id // 100 as varchar)
                  || '/' || cast(doc_id as varchar) || '.txt' as path from documents),
g as (select *, regexp_replace(path, '/?[^/]*$', '') as dir from f),
lines as (select rid, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos
          from g where regexp_matches(t, '{TERMS}')),
hits as (select *, regexp_matches(line, '{TERMS}') as hit from lines),
near as (select *, max(case when hit then pos end) {_LAST} as before_at, min(case when hit then pos end) {_NEXT} as after_at
         from hits),
inside as (select *, case when pos - lag(pos) over (partition by rid order by pos) <= 1 then 0 else 1 end as fresh
           from near where hit or after_at - before_at <= {GAP_LINES + 1}),
blocks as (select *, sum(fresh) {_LAST} as block from inside),
headers as (select rid, block, string_agg(line, ' ' order by pos) as header from blocks group by all),
tokens as (select rid, block, word, count(*) as n from
           (select rid, block, unnest(regexp_extract_all(lower(header), '{WORD}')) as word from headers) group by all),
vectors(template, licence, word, weight) as (values {_sql(_VECTORS)}),
idf(word, idf) as (values {_sql(idf_rows())}),
w as (select rid, block, tokens.word, n, n * coalesce(idf.idf, {_OTHER!r}) as w from tokens left join idf on tokens.word = idf.word),
norms as (select rid, block, sqrt(sum(w * w)) as norm, sum(n) as n_words from w group by all),
dots as (select rid, block, template, licence, sum(w * weight) as dot from w join vectors on w.word = vectors.word group by all),
scored as (select d.*, n_words, round(dot / norm, 6) as similarity from dots d join norms n on d.rid = n.rid and d.block = n.block),
best as (select * from scored where similarity >= {THRESHOLD}
         qualify row_number() over (partition by rid, block order by similarity desc, licence, template) = 1),
own as (select *, sum(n_words) over (partition by rid) as licence_words from best
        qualify row_number() over (partition by rid order by similarity desc, licence) = 1),
held as (select doc_id, path, dir, licence, similarity,
                coalesce(100 * licence_words >= {FILE_PERCENT} * len(regexp_extract_all(lower(t), '{WORD}')), false) as is_file
         from g left join own on g.rid = own.rid),
governing as (select dir as up, licence, similarity from held where is_file and dir is not null
              qualify row_number() over (partition by dir order by similarity desc, licence) = 1),
nearest as (select d.dir, up, licence, similarity from (select distinct dir from held where dir is not null) d
            join governing on up = '' or d.dir = up or starts_with(d.dir, up || '/')
            qualify row_number() over (partition by d.dir order by length(up) desc) = 1)
select doc_id, path, case when h.licence is not null then h.licence else x.licence end as licence,
       case when h.licence is not null then h.similarity else x.similarity end as similarity,
       case when is_file then 'file' when h.licence is not null then 'header' when x.dir is not null then 'directory' end as via,
       case when h.licence is not null then h.dir else x.up end as licence_dir
from held h left join nearest x on h.dir = x.dir
"""
