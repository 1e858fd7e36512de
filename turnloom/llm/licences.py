"""Operator 1: licence scans with DataFrame functions only.

Texts are cut into segments (lines and sentences). Segments and licence templates are sparse TF-IDF vectors over lower-cased words but function words, with the
templates' document frequencies; a segment's licence is its nearest template's if the cosine is at least `least`. A text that is mostly
licence segments is a licence file and stands for its directory; others with such a segment have a licence header. All other texts inherit from the
nearest directory above them that has a licence file, found by joining the directories' ancestors with the licence files' directories.

Besides, blocks are compared with full notices and licence files, which are wrapped over several lines: paragraphs, the comment lines at the start of a
text, and the whole text. A whole text that reaches a template is a licence file; so is a text with a paragraph that stands only in the file of a long
licence, near its beginning. Comment marks are no words, so they need not be dropped.

Only segments and blocks that hold one of a few weighty words of the templates are compared: the words are so many that the rest of any template is
shorter than `least`, so a segment without them cannot reach it.

The texts that hold such a word are dealt out once, by id and digest; cutting, counting, and comparing with all templates is one aggregation
in the same tasks.

Defined cases: null, empty and wordless texts have no segments; a null path is the empty path, in the root directory; several licences in one
text: the one of greatest cosine, then the first by name; several licence files in a directory: likewise, then the first path; repeated rows get equal results; rows
of one id, or without id, with different texts are judged each by its own text; a very long text is one row of one task, with a row for each of
its terms; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licence names and what their headers and files say.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
    "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MOZILLA = (
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed "
    "under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)


def _gnu(thing: str, name: str, version: str) -> tuple[str, str]:
    """First paragraph, and all, of the notice that a GNU licence asks for."""
    first = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = f" This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {thing}. If not, see https://www.gnu.org/licenses/."
    return first, first + rest


# Full notices and short licence files, compared with blocks.
BLOCK_TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _GRANT),
    ("MIT", f"MIT License {_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License {_ISC} {_ISC_AS_IS}"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", _MOZILLA),
    ("Unlicense", _UNLICENSE),
    *((licence, text) for licence, *notice in (
        ("GPL-2.0", "program", "General Public License", "2"),
        ("GPL-3.0", "program", "General Public License", "3"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "library", "Lesser General Public License", "3"),
        ("AGPL-3.0", "program", "Affero General Public License", "3"),
    ) for text in _gnu(*notice)),
)

# Paragraphs that stand in the file of a long licence only, near its beginning.
OPENINGS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-1.1", '1.1. "Contributor" means each entity that creates or contributes to the creation of Modifications.'),
    ("MPL-2.0", '1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("EPL-2.0", 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENTS ACCEPTANCE OF THIS AGREEMENT.'),
    ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an owner) of an original work of authorship and/or a database (each, a Work)."),
)
BLOCKS = BLOCK_TEMPLATES + OPENINGS

# Function words, which are left out of the vectors.
FUNCTION_WORDS = tuple("a an and any are as at be by can for from if in into is it may not of on or that the this to under use with without you".split())
# Words chosen last as trigger words.
FREQUENT = frozenset("0 2 3 4 version work general public free terms either later file person code".split())

TERM_BREAK = "[^a-z0-9]+"
COMMENT = "^\\s*(?:#|//|/\\*|\\*|--|;|%|<!--|$)"
PARAGRAPH_END = "\n[^\\p{L}\\p{N}\n]*\n"
SEGMENT_END = "([.;!?])[ \\t]+"


def template_weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight) with vectors of length 1; idf by term; the idf of a term in no template. Of the fixed values alone."""
    terms = [Counter(t for t in re.split(TERM_BREAK, text.lower()) if t and t not in FUNCTION_WORDS) for _, text in templates]
    df = Counter(t for c in terms for t in c)
    idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for k, ((licence, _), c) in enumerate(zip(templates, terms, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out += [(k, licence, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return out, idf, math.log(1 + len(terms)) + 1


def trigger_words(weights: list[tuple[int, str, str, float]], least: float) -> list[str]:
    """Words without which no template can be reached: what is left of each template is shorter than least."""
    chosen: set[str] = set()
    for k in {w[0] for w in weights}:
        own = sorted(((w, t) for n, _, t, w in weights if n == k), key=lambda x: (x[1] in FREQUENT, -x[0]))
        while sum(w * w for w, t in own if t not in chosen) >= least * least * 0.999:
            chosen.add(next(t for w, t in own if t not in chosen))
    return sorted(chosen)


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    def literal(x) -> str:
        if isinstance(x, list):
            return f"array({', '.join(map(literal, x))})"
        return f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({names})")


def _holds(templates: tuple[tuple[str, str], ...], least: float) -> str:
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(trigger_words(template_weights(templates)[0], least))})(?![a-z0-9])"


def segment_matches(texts: DataFrame, least: float) -> DataFrame:
    """(id, key, place, chars, cosine, licence, template) of each segment that reaches a template; texts: (id, key, text)."""
    parts = F.split(F.regexp_replace("text", SEGMENT_END, "$1\n"), "\n")
    return _nearest(texts.select("id", "key", F.posexplode(parts).alias("place", "segment")), TEMPLATES, least)


def block_matches(texts: DataFrame, least: float) -> DataFrame:
    """The same of each block that reaches a full template or an opening: the whole text (place 0), the comment lines at its start (1), and its paragraphs."""
    lines = F.split("text", "\n")
    code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), F.lit(False))
    comments = F.array_join(F.slice(lines, F.lit(1), F.when(code > 0, code - 1).otherwise(F.size(lines)).cast("int")), "\n")
    blocks = F.concat(F.array(F.col("text"), comments), F.split("text", PARAGRAPH_END))
    return _nearest(texts.select("id", "key", F.posexplode(blocks).alias("place", "segment")), BLOCKS, least)


def _nearest(segments: DataFrame, templates: tuple[tuple[str, str], ...], least: float) -> DataFrame:
    """The nearest template of each of the segments (id, key, place, segment) that reaches one; segments come partitioned by id and key."""
    weights, idf, unseen = template_weights(templates)
    of_term: dict[str, list[float]] = {t: [0.0] * len(templates) for t in idf}
    for k, _, t, w in weights:
        of_term[t][k] = w
    # a fixed table of some hundred terms: idf, and the weight in each template
    known = F.broadcast(_values(segments.sparkSession, [(t, idf[t], own) for t, own in sorted(of_term.items())], "term, idf, weights"))
    held = segments.where(F.col("segment").rlike(_holds(templates, least)))
    terms = held.select("id", "key", "place", F.char_length("segment").alias("chars"), F.explode(F.split(F.lower("segment"), TERM_BREAK)).alias("term"))
    counted = terms.where((F.col("term") != "") & ~F.col("term").isin(*FUNCTION_WORDS)).groupBy("id", "key", "place", "chars", "term").agg(F.count("*").alias("tf"))
    valued = counted.join(known, "term", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    dots = [F.sum(F.col("value") * F.coalesce(F.col("weights")[k], F.lit(0.0))).alias(f"dot_{k}") for k in range(len(templates))]
    summed = valued.groupBy("id", "key", "place", "chars").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), *dots)
    less = [F.struct((-F.round(F.col(f"dot_{k}") / F.col("norm"), 6)).alias("less"), F.lit(licence).alias("licence"), F.lit(k).alias("template")) for k, (licence, _) in enumerate(templates)]
    nearest = summed.select("id", "key", "place", "chars", F.array_min(F.array(*less)).alias("best"))
    return nearest.select("id", "key", "place", "chars", (-F.col("best.less")).alias("cosine"), "best.licence", "best.template").where(F.col("cosine") >= least)


def licence_scan(files: DataFrame, least: float = 0.75, file_share: float = 0.25) -> DataFrame:
    """(id, path, licence, origin, cosine, from_dir) of every row of files (id, path, text); origin: file, header, inherited or none."""
    files = files.select("id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    placed = files.select("id", "key", "path", directory.alias("dir"), F.char_length("text").alias("text_chars"))
    either = F.col("text").rlike(_holds(TEMPLATES, least)) | F.col("text").rlike(_holds(BLOCKS, least))
    texts = files.where(either).groupBy("id", "key").agg(F.first("text").alias("text"))
    lines = segment_matches(texts, least).withColumn("is_text", F.lit(False))
    blocks = block_matches(texts, least).withColumns({"is_text": (F.col("place") == 0) | (F.col("template") >= len(BLOCK_TEMPLATES)), "chars": F.lit(0)})
    best = F.min(F.struct((-F.col("cosine")).alias("less"), "licence"))
    by_file = lines.unionByName(blocks).groupBy("id", "key").agg(best.alias("best"), F.sum("chars").alias("licence_chars"), F.max("is_text").alias("is_text"))
    by_file = by_file.select(F.col("id").alias("own_id"), F.col("key").alias("own_key"), "is_text", F.col("best.licence").alias("own"), (-F.col("best.less")).alias("own_cosine"), "licence_chars")
    own = placed.join(by_file, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    own = own.withColumn("is_file", F.coalesce(F.col("is_text") | (F.col("licence_chars") >= F.col("text_chars") * file_share), F.lit(False)))
    by_dir = own.where("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("less"), F.col("own").alias("licence"), "path")).alias("best"))
    by_dir = by_dir.select(F.col("dir").alias("from_dir"), F.col("best.licence").alias("dir_licence"), (-F.col("best.less")).alias("dir_cosine"))
    levels = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.size(levels), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(levels, F.lit(1), k), "/")), F.array(F.lit("")))
    ancestors = placed.select("dir").distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("up", "from_dir"))
    nearest = ancestors.join(by_dir, "from_dir").groupBy("dir").agg(F.min_by(F.struct("from_dir", "dir_licence", "dir_cosine"), "up").alias("near"))
    joined = own.join(nearest, "dir", "left")
    return joined.select(
        "id",
        "path",
        F.coalesce("own", "near.dir_licence").alias("licence"),
        F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("own_cosine", "near.dir_cosine").alias("cosine"),
        F.when(F.col("own").isNull(), F.col("near.from_dir")).alias("from_dir"),
    )


def _sql_nearest(name: str, segments: str, templates: tuple[tuple[str, str], ...], least: float) -> str:
    """Common table expressions that end in best_<name> (doc_id, place, chars, licence, cosine, template) of the segments of another."""
    literal = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}e0" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    weights, idf, unseen = template_weights(templates)
    return f"""
weights_{name}(template, licence, term, weight) AS (VALUES {literal(weights)}),
idf_{name}(term, idf) AS (VALUES {literal(sorted(idf.items()))}),
terms_{name} AS (SELECT doc_id, place, length(segment) AS chars, unnest(string_split_regex(lower(segment), '[^a-z0-9]+')) AS term FROM {segments}),
counted_{name} AS (SELECT doc_id, place, chars, term, count(*) AS tf FROM terms_{name} WHERE term <> '' AND term NOT IN {FUNCTION_WORDS!r} GROUP BY ALL),
valued_{name} AS (SELECT c.*, tf * coalesce(idf, {unseen!r}e0) AS value FROM counted_{name} c LEFT JOIN idf_{name} USING (term)),
norms_{name} AS (SELECT doc_id, place, chars, sqrt(sum(value * value)) AS norm FROM valued_{name} GROUP BY ALL),
dots_{name} AS (SELECT doc_id, place, template, licence, sum(value * weight) AS dot FROM valued_{name} JOIN weights_{name} USING (term) GROUP BY ALL),
cosines_{name} AS (SELECT doc_id, place, chars, template, licence, round(dot / norm, 6) AS cosine FROM dots_{name} JOIN norms_{name} USING (doc_id, place) WHERE round(dot / norm, 6) >= {least}),
best_{name} AS (SELECT * FROM cosines_{name} QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY cosine DESC, licence, template) = 1),"""


def oracle_sql(table: str, path: str, least: float = 0.75, file_share: float = 0.25) -> str:
    """The same in SQL, without the choice of segments beforehand. table has doc_id (a key) and text; path is an expression."""
    comment, paragraph_end = COMMENT, PARAGRAPH_END.replace("\n", "\\n")
    return f"""
WITH files AS (SELECT doc_id, {path} AS path, coalesce(text, '') AS text FROM {table}),
placed AS (SELECT doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, length(text) AS text_chars FROM files),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.;!?])[ \t]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM files),
segments AS (SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS segment FROM cut),
lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM files),
opened AS (SELECT doc_id, text, lines, list_position(list_transform(lines, lambda x: regexp_matches(x, '{comment}')), false) AS code FROM lined),
pieces AS (SELECT doc_id, [text, array_to_string(CASE WHEN coalesce(code, 0) > 0 THEN lines[1:code - 1] ELSE lines END, chr(10))] || string_split_regex(text, '{paragraph_end}') AS parts FROM opened),
blocks AS (SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS segment FROM pieces),
{_sql_nearest("line", "segments", TEMPLATES, least)}
{_sql_nearest("block", "blocks", BLOCKS, least)}
best AS (SELECT doc_id, chars, licence, cosine, false AS is_text FROM best_line UNION ALL SELECT doc_id, 0, licence, cosine, place = 0 OR template >= {len(BLOCK_TEMPLATES)} FROM best_block),
by_file AS (SELECT doc_id, first(licence ORDER BY cosine DESC, licence) AS own, max(cosine) AS own_cosine, sum(chars) AS licence_chars, bool_or(is_text) AS is_text FROM best GROUP BY doc_id),
own AS (SELECT p.*, own, own_cosine, coalesce(is_text OR licence_chars >= text_chars * {file_share}, false) AS is_file FROM placed p LEFT JOIN by_file USING (doc_id)),
by_dir AS (SELECT dir AS from_dir, own AS dir_licence, own_cosine AS dir_cosine FROM own WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_cosine DESC, own, path) = 1),
dirs AS (SELECT DISTINCT dir FROM placed),
nearest AS (SELECT d.dir, b.* FROM dirs d JOIN by_dir b ON d.dir = b.from_dir OR starts_with(d.dir, b.from_dir || '/') OR b.from_dir = '' QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(b.from_dir) DESC) = 1)
SELECT doc_id, path, coalesce(own, dir_licence) AS licence,
  CASE WHEN is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN from_dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  coalesce(own_cosine, dir_cosine) AS cosine, CASE WHEN own IS NULL THEN from_dir END AS from_dir
FROM own LEFT JOIN nearest USING (dir)
"""
