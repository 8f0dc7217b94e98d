"""Licence scans by canonical digest lookup.

A text is brought into a canonical form (letter case, punctuation, copyright lines,
headings and equivalent spellings no longer matter, nor do line breaks) and its digest
is looked up among the digests of known licence texts by a hash join. Besides the
whole text, the stretch of a known text's length is looked up wherever a line begins
with the first words of one, for documents that carry a licence among other text.

The known texts are a table (a parameter). A document without a word that some known
text needs is not brought into canonical form; which words these are follows from the
table. Documents are projected and exploded where they lie; only hits are shuffled, and
then joined to the documents' keys, which carry no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import cut, documents

QUERY = "op8_licenses"
#: Known notices, standard headers and whole licence texts, by SPDX identifier. Longer ones (Apache, GNU, Mozilla, Creative Commons) come as a table: ``known_files`` reads it.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "MIT-0",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n'
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n'
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n'
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n'
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n"
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n"
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.\n"
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.\n"
        "You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.\n"
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.\n"
        "You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
#: Equivalent spellings, applied in this order to lower-case text (pattern, replacement).
SPELLINGS = (
    (r"licence", "license"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"non-infring", "noninfring"),
    (r"https?://(www\.)?", ""),
    (r"\bv(ersion)?\.? ?([0-9])", "version \\2"),
    (r"([0-9])\.0\b", "\\1"),
    (r"\bgpl\b", "gnu general public license"),
    (r"copyright (owner|holder)s?", "copyright holders"),
)
#: Lines that are no part of a licence, in lower case: a copyright line (the word or sign, with a year or as one) and what often follows it.
COPYRIGHT = r"^[\x20\t#*/;-]*(copyright[\x20\t]*(\(c\)|\x{A9})|\x{A9}|(copyright|\(c\)).*[0-9]{4}|all rights reserved[.!]?[\x20\t\r]*$)"
#: Headings of licence texts, in canonical form.
HEADING = "^(the )?(mit|isc|zlib|apache|bsd [023] clause|new bsd|simplified bsd|boost software|mozilla public|gnu (lesser |affero )?general public) license( mit| version [0-9]+)*( [0-9]+ january [0-9]{4}| [0-9]+ june [0-9]{4}| january [0-9]{4})?$"
#: A place where a known text may begin is found by this many of its words, or fewer if a known text has fewer.
ANCHOR = 4
#: What the spellings above can make of something else: such words say nothing about the text as written.
_MADE = "licens|noncommercial|noninfring|version|gnu|general|public|copyright|holders|[^a-z]"


def canonical_line(line: Column) -> Column:
    """One line without copyright notice, heading, letter case, punctuation and spelling variants: words joined by single blanks."""
    out = F.lower(line)
    out = F.when(out.rlike(COPYRIGHT), F.lit("")).otherwise(out)
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(out, HEADING, "")


def canonical_lines(text: Column) -> Column:
    """The lines' canonical forms, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\n", -1), canonical_line), lambda x: x != "")


def known_table(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(license, text) of known texts."""
    return spark.createDataFrame(list(known), "license string, text string")


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of the files of a folder that holds one whole licence text each, named by its identifier."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def _digests(known: DataFrame) -> DataFrame:
    """(license, digest, n, first, sign) of each different canonical form: its words, the first of them, and a pattern that every text with it matches (the first identifier by name)."""
    forms = known.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("form")).filter("form != ''").groupBy("form").agg(F.min("license").alias("license"))
    words = F.split("form", " ")
    plain = F.array_max(F.transform(F.filter(words, lambda w: ~w.rlike(_MADE)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    # without a word that stands in the text as it stands here, any text may match
    sign = F.when(F.col("form").contains("licens"), F.lit("licen[cs]|gpl")).otherwise(F.coalesce(plain, F.lit("")))
    return forms.select("license", F.md5("form").alias("digest"), F.size(words).alias("n"), F.slice(words, 1, ANCHOR).alias("first"), sign.alias("sign"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, whole_license (of the whole text, or null), n_license_blocks (places where a known text begins) and licenses (all found, by name, comma-joined; '' if none).

    ``known`` (license, text) defaults to ``KNOWN``. What it gives the driver is its
    lengths and first words; it is the size of a list of licences, not of a corpus.
    Of known texts equal in canonical form the first identifier by name counts.
    Where one known text is the beginning of another, both are found, at one place;
    the whole text's licence is unique. A null text is empty and has no licence, nor
    has a text that is empty in canonical form. Texts are read from end to end.
    Rows equal in id and text have equal results; null ids are scanned like others.
    An empty table gives no rows. Other columns are not read.
    """
    known = cut(_digests(known if known is not None else known_table(docs.sparkSession)))
    shapes = known.select("n", "first", "sign").distinct().collect()
    k = min([ANCHOR, *(r.n for r in shapes)])
    firsts, lengths = sorted({" ".join(r["first"][:k]) for r in shapes}), sorted({r.n for r in shapes})
    signs = sorted({r.sign for r in shapes})
    key = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.coalesce("text", F.lit("")).alias("text"))
    signed = key.filter(F.lower("text").rlike("|".join(signs))) if all(signs) else key
    tokens = F.split(F.array_join(canonical_lines(F.col("text")), " \n "), " ")
    lines = signed.select("doc_id", "h", "g", tokens.alias("tokens")).select("doc_id", "h", "g", F.array_remove("tokens", "\n").alias("words"), F.filter(F.transform("tokens", lambda w, i: F.when(w == "\n", i)), lambda i: i.isNotNull()).alias("breaks"))
    starts = F.concat(F.array(F.lit(1)), F.transform("breaks", lambda p, i: p - i + 1))
    placed = F.filter(starts, lambda s: F.array_join(F.slice("words", s, k), " ").isin(firsts))
    size = F.size("words")
    digest = lambda s, n: F.when(s + n - 1 <= size, F.md5(F.array_join(F.slice("words", s, n), " ")))
    every = F.flatten(F.transform(placed, lambda s: F.transform(F.array(*map(F.lit, lengths)), lambda n: F.struct(s.alias("start"), ((s == 1) & (n == size)).alias("whole"), digest(s, n).alias("digest")))))
    hits = lines.select("doc_id", "h", "g", F.explode(F.filter(every, lambda x: x["digest"].isNotNull())).alias("x")).select("doc_id", "h", "g", "x.*").join(known.select("digest", "license"), "digest")
    found = hits.groupBy("doc_id", "h", "g").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.size(F.collect_set("start")).cast("long").alias("n_license_blocks"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
    )
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("g").alias("__g"), "whole_license", "n_license_blocks", "licenses")
    joined = key.drop("text").join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")), "left")
    return joined.select("doc_id", "whole_license", F.coalesce("n_license_blocks", F.lit(0).cast("long")).alias("n_license_blocks"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text"))


def _canonical_sql(line: str) -> str:
    out = f"lower({line})"
    out = f"CASE WHEN regexp_matches({out}, '{COPYRIGHT}') THEN '' ELSE {out} END"
    for pattern, by in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"regexp_replace({out}, '{HEADING}', '')"


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    forms = lambda text: f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_canonical_sql('x')}), lambda x: x <> '')"
    values = ", ".join(f"('{i}', {quoted(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (
  SELECT form, min(license) AS license FROM (SELECT license, array_to_string({forms("t")}, ' ') AS form FROM (VALUES {values}) AS v(license, t)) GROUP BY form
), sized AS (
  SELECT *, len(string_split(form, ' ')) AS n, string_split(form, ' ')[1] AS opening FROM known
), rows_ AS (
  SELECT row_number() OVER () AS k, doc_id, text FROM documents
), parts AS (
  SELECT k, {forms("coalesce(text, '')")} AS forms FROM rows_
), lines AS (
  SELECT k, unnest(forms) AS form, generate_subscripts(forms, 1) AS i FROM parts
), starts AS (
  SELECT k, string_split(form, ' ')[1] AS opening,
         1 + coalesce(sum(len(string_split(form, ' '))) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM lines
), wholes AS (
  SELECT k, string_split(array_to_string(forms, ' '), ' ') AS words FROM parts
), hits AS (
  SELECT s.k, s.place, license, s.place = 1 AND n = len(words) AS whole
  FROM starts s JOIN sized USING (opening) JOIN wholes w ON w.k = s.k
  WHERE array_to_string(words[CAST(s.place AS BIGINT):CAST(s.place + n - 1 AS BIGINT)], ' ') = form
), found AS (
  SELECT k, max(license) FILTER (whole) AS whole_license, count(DISTINCT place) AS n_license_blocks,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM hits GROUP BY k
)
SELECT d.doc_id, whole_license, coalesce(n_license_blocks, 0) AS n_license_blocks, coalesce(licenses, '') AS licenses
FROM rows_ d LEFT JOIN found USING (k)
"""


ORACLE_SQL = _sql()
