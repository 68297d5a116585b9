"""License scans by canonical digest lookup.

A text is canonicalised line by line: lower case, lines that only state a copyright
(its sign or word, a year, and up to eleven words more, none of them licence) dropped, equivalent spellings made one, everything but letters and digits turned to
single blanks, empty lines dropped, lines joined by a blank.  The digest is the
SHA-256 of what is left.  Whole texts are hash-joined to the digests of the known
licences, canonicalised by the same expression; so is every whole line, which finds
the one-line notices that documents end with.  DataFrame operations only, one pass
over the texts, no shuffle: the known digests, at most `KNOWN_MOST`, are broadcast.

Rows: a null or empty text, or one without letters and digits, has the digest of
the empty text and no licence.  A text is joined as a whole at any length.  If two
known texts have the same canonical form, the smaller name counts.  Repeated rows
and null ids are scanned like any other.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound on the known texts, so that their digests can be broadcast.
KNOWN_MOST = 10_000

#: Spellings that mean the same, after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("https:", "http:"),
    ("&", " and "),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("v. ", "version "),
)

#: Public licence texts and one-line notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Licensed under the MIT License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "rights-reserved-notice": "All rights reserved.",
}

#: Full licence texts shipped as files of `license_texts`, by SPDX id.
TEXTS = (
    "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense",
)
_END = "END OF TERMS AND CONDITIONS"


def full_texts() -> dict[str, str]:
    """The shipped texts; those with an appendix also without it, as `<id>-terms`."""
    out = {n: pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode("utf-8") for n in TEXTS}
    return out | {f"{n}-terms": t[: t.index(_END) + len(_END)] for n, t in out.items() if _END in t}


_COPYRIGHT = r"^\s*\W*(copyright\b|\(c\)|©)[^a-z]*(\(c\)|©|[0-9]{4})(\W+[A-Za-z0-9_]+){0,11}\W*$"
_LICENSED = "licen[cs]"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty ones."""

    def line(x: Column) -> Column:
        x = F.lower(x)
        for a, b in SPELLINGS:
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.trim(F.regexp_replace(F.when(~x.rlike(_COPYRIGHT) | x.rlike(_LICENSED), x), r"[^\p{L}\p{N}]+", " "))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line), lambda x: F.coalesce(x != "", F.lit(False)))


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def known_digests(spark: SparkSession, known: Mapping[str, str]) -> DataFrame:
    """digest, license_id and length of each known canonical text."""
    if len(known) > KNOWN_MOST:
        raise ValueError(f"at most {KNOWN_MOST} known texts")
    rows = spark.createDataFrame(sorted(known.items()), "name string, body string").withColumn("body", F.array_join(canonical_lines(F.col("body")), " "))
    return rows.groupBy(_sha(F.col("body")).alias("digest")).agg(F.min("name").alias("license_id"), F.max(F.char_length("body")).alias("size"))


def scan(docs: DataFrame, known: Mapping[str, str] = KNOWN) -> DataFrame:
    """doc_id, digest, license_id (of the whole text), n_lines (canonical lines),
    notices (known texts that are whole lines, as often as they occur, in order)."""
    digests = known_digests(docs.sparkSession, known)
    found = digests.orderBy("digest").collect()
    by_digest = F.create_map(*(F.lit(x) for r in found for x in r[:2])) if found else F.create_map().cast("map<string, string>")
    lines = docs.select("doc_id", canonical_lines(F.col("text").cast("string")).alias("lines"))
    # a longer line than any known text has another canonical form
    longest = max((r["size"] for r in found), default=0)
    found = F.transform("lines", lambda x: F.when(F.char_length(x) <= longest, F.element_at(by_digest, _sha(x))))
    whole = lines.select(
        "doc_id",
        _sha(F.array_join("lines", " ")).alias("digest"),
        F.size("lines").cast("long").alias("n_lines"),
        F.filter(found, lambda x: x.isNotNull()).alias("notices"),
    )
    return whole.join(F.broadcast(digests.drop("size")), "digest", "left").select("doc_id", "digest", "license_id", "n_lines", "notices")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Known licences among the texts and lines of `documents`."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), KNOWN | full_texts())
    return found.withColumn("notices", F.array_join("notices", " "))


def _sql_line(x: str) -> str:
    out = f"lower({x})"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(CASE WHEN NOT regexp_matches({out}, '{_COPYRIGHT}') OR regexp_matches({out}, '{_LICENSED}') THEN {out} END, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def sql() -> str:
    """The query in DuckDB's SQL, over `KNOWN`: without the full texts of `TEXTS`."""
    lines = "list_filter([{} FOR x IN string_split(coalesce({}, ''), chr(10))], lambda y: coalesce(y <> '', false))"
    body = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(KNOWN.items()))
    return f"""
WITH known AS (
  SELECT sha256(array_to_string({lines.format(_sql_line("x"), "body")}, ' ')) AS digest, min(name) AS license_id
  FROM (VALUES {body}) AS k(name, body) GROUP BY 1),
names AS (SELECT map(list(digest), list(license_id)) AS m FROM known),
d AS (SELECT doc_id, {lines.format(_sql_line("x"), "text")} AS lines FROM documents),
w AS (SELECT doc_id, lines, sha256(array_to_string(lines, ' ')) AS digest FROM d)
SELECT w.doc_id, w.digest, known.license_id, CAST(len(w.lines) AS BIGINT) AS n_lines,
  array_to_string(list_filter([m[sha256(x)] FOR x IN w.lines], lambda y: y IS NOT NULL), ' ') AS notices
FROM w CROSS JOIN names LEFT JOIN known ON known.digest = w.digest"""
