"""Licence scan by canonical digests (operator 6); DataFrame operations only.

Known licence texts and a document are brought to one canonical form (case,
punctuation, white space, copyright lines, equivalent spellings), and the digests of
entire canonical texts are hash-joined: a document as a whole, and each of its lines
as a notice.  The known side is the fixed lists here and the whole texts in
license_texts, or a table that is passed in; it is broadcast; lines are neither
shuffled nor kept.  Matches are few; they are grouped by document.

Null, empty and white texts match nothing.  Rows that repeat an id share what is
found in any of them, and so do rows without an id.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Notices that stand for a licence, by SPDX name.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Whole licence texts (publicly known), by SPDX name.
TEXTS = [
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_END}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_WARRANTY}"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
]
#: Names whose SPDX lines are notices.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.2-only GFDL-1.3-only"
    " GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later"
    " MIT MIT-0 MPL-1.1 MPL-2.0 Unlicense WTFPL Zlib"
).split()
#: Where the terms of a whole text end and advice on using it begins.
AFTER_TERMS = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", re.M)
#: Spellings that count as the one after them, in lower-case text without punctuation.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("copyright owner", "copyright holder"),
    ("copyright holders", "copyright holder"),
    ("https", "http"),
]
#: A line that says who holds the rights: copyright or (c), with a mark, a year or a placeholder.
COPYRIGHT = r"(^|\n)[ \t*#/]*(copyright[ \t:]*(\(c\)|©|[0-9]|<|\[)|\(c\)[ \t]*[0-9]|©)[^\n]*"
TITLE = r"^\s*(the )?(mit|isc|bsd|zlib|zero-clause bsd|bsd [23]-clause|[23]-clause bsd) license[ \t]*(\([a-z0-9 -]+\))?[ \t]*\n"


PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """A text's lines in the form in which two count as the same, array<string>; each step passes over the whole text once."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, "$1"), TITLE, "")
    t = F.regexp_replace(t, PUNCTUATION, " ")
    for known, to in SPELLINGS:
        t = F.replace(t, F.lit(known), F.lit(to))
    return F.transform(F.split(t, "\n"), lambda line: F.trim(line))


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def known(spark: SparkSession) -> DataFrame:
    """digest, license, whole: of the fixed texts (whole) and notices."""
    rows = [(name, text, True) for name, text in TEXTS] + [(name, text, False) for name, text in NOTICES]
    fixed = spark.createDataFrame(rows, "license string, text string, whole boolean")
    return digests(fixed)


def shipped() -> list[tuple[str, str, bool]]:
    """license, text, whole: of the files of whole texts, with and without what follows their terms, and of SPDX lines."""
    rows = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text("utf-8")
        rows.append((path.stem, text, True))
        if after := AFTER_TERMS.search(text):
            rows += [(path.stem, text[:at], True) for at in (after.start(), after.end())]
    return rows + [(name, f"SPDX-License-Identifier: {name}", False) for name in SPDX]


def digests(texts: DataFrame) -> DataFrame:
    """digest, license, whole: of ``texts`` (license, text, whole)."""
    return texts.select(F.sha2(whole(canonical_lines(F.col("text"))), 256).alias("digest"), "license", "whole").distinct()


def every_known(spark: SparkSession) -> DataFrame:
    """What ``known`` has and what is shipped."""
    return known(spark).unionByName(digests(spark.createDataFrame(shipped(), "license string, text string, whole boolean"))).distinct()


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, line (from 1; 0: the text as a whole), license: every match of ``docs`` (doc_id, text).

    ``texts`` (license, text, whole) are the known ones instead of those of this module.
    """
    against = every_known(docs.sparkSession) if texts is None else digests(texts)
    rows = docs.select("doc_id", canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    parts = F.transform("lines", lambda form, i: F.struct((i + 1).alias("line"), form.alias("form")))
    units = rows.select("doc_id", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("line"), whole(F.col("lines")).alias("form"))), parts)))
    units = units.filter("form != ''").select("doc_id", "line", F.sha2("form", 256).alias("digest"))
    against = against.select("digest", "license").distinct()
    against = F.broadcast(against) if texts is None else against  # a table that is given may be of any size
    return units.join(against, "digest").select("doc_id", "line", "license")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license (of the text as a whole, or null), notices (licences of its lines, in order, comma-joined), n_notices."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs).groupBy("doc_id").agg(
        F.min(F.when(F.col("line") == 0, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.col("license")))), ",").alias("notices"),
        F.count(F.when(F.col("line") > 0, 1)).alias("n_notices"),
    )
    both = docs.select("doc_id").alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return both.select("d.doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    form = "lower(text)"
    for pattern, to in [(COPYRIGHT, r"\1"), (TITLE, ""), (PUNCTUATION, " ")]:
        form = f"regexp_replace({form}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    for spelling, to in SPELLINGS:
        form = f"replace({form}, {_quoted(spelling)}, {_quoted(to)})"
    lines = f"[trim(x) for x in string_split({form}, chr(10))]"
    joined = "array_to_string([x for x in lines if x <> ''], ' ')"
    fixed = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in [*TEXTS, *NOTICES, *((n, t) for n, t, _ in shipped())])
    return f"""
WITH known AS (SELECT DISTINCT license, sha256({joined}) AS digest FROM (SELECT license, {lines} AS lines FROM (VALUES {fixed}) v(license, text))),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
forms AS (SELECT doc_id, {lines} AS lines FROM docs),
units AS (
  SELECT doc_id, 0 AS line, {joined} AS form FROM forms
  UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1)), unnest(lines) FROM forms
), found AS (
  SELECT doc_id, line, license FROM (SELECT doc_id, line, sha256(form) AS digest FROM units WHERE form <> '') JOIN known USING (digest)
), grouped AS (
  SELECT doc_id, min(license) FILTER (line = 0) AS license,
    coalesce(array_to_string(list_sort(list_distinct(list(license) FILTER (line > 0))), ','), '') AS notices,
    count(*) FILTER (line > 0) AS n_notices
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM docs d LEFT JOIN grouped g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""


SQL = _sql()
