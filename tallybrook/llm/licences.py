"""Licence scan by canonical digest: normalise the whole text, hash it, hash-join to known licence digests.

Canonical form: lower case; copyright lines, licence title lines at the top and "all rights
reserved" dropped; equivalent spellings made one (licence and
license, copyright signs, quotes, dashes, http and https); every run of other characters than
letters and digits one space; ends trimmed.  Two texts are the same licence if their canonical
SHA-256 digests are equal.  All of it is built-in column functions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TITLE = (
    r"(the )?(mit|mit/x11|x11|isc|zlib|expat|0bsd|apache|unlicense|bsd|(bsd )?(zero|[0-9])[ -]clause( bsd)?|(new|modified|simplified|original) bsd|gnu (lesser |library |affero )?general public|gnu free documentation|mozilla public)"
    r" licen[cs]e,?( v(ersion)? ?[0-9.]+)?( \([^\n)]*\))?|version [0-9.]+, [^\n]{0,20}[0-9]{4}"
)

# Spellings taken as one (pattern on lower-case text, its single form), in order.
SPELLINGS = (
    (rf"^([^\p{{L}}\p{{N}}]*({_TITLE})[^\p{{L}}\p{{N}}\n]*\n)+", "\n"),
    (r"all rights reserved\b", ""),
    ("©|\\(c\\)", "copyright"),
    ("https?://", ""),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("wilful", "willful"),
    ("whilst", "while"),
    ("&", " and "),
)

# Short public licence texts and notices, as published, by SPDX id (or id and form).
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

#: The texts of longer licences as published, each in a file named by its SPDX id.
KNOWN |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
KNOWN["Apache-2.0 without appendix"] = KNOWN["Apache-2.0"].split("APPENDIX:")[0]

#: A copyright line, behind a comment leader or not, has a copyright sign, a year or a placeholder; a sentence that
#: only mentions the notice or its holders stays, and so does a holder without any of the three.
_COPYRIGHT = (
    r"(^|\n)[^\p{L}\p{N}\n(©]*(portions[ \t]+)?"
    r"(copyright[ \t]*(\(c\)|©)|copyright[ \t:,]+([0-9]{4}|[\[<{])|\(c\)[ \t]*(copyright|[0-9]{4}|[\[<{])|©)[^\n]*"
)


def canonical(text: Column) -> Column:
    """The canonical form; null for null."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, "\r\n?", "\n")), _COPYRIGHT, "\n")
    for pattern, single in SPELLINGS:
        out = F.regexp_replace(out, pattern, single)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(canon_sha256, license_id): one row a digest, the first id by name where several texts are the same."""
    rows = spark.createDataFrame(sorted((texts or KNOWN).items()), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("canon_sha256")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, canon_chars, canon_sha256, license_id (null where the whole text is no known licence).

    ``known`` has (canon_sha256, license_id), one row a digest; Spark picks the join by its size. A null text has
    null columns and matches nothing; a text without letters or digits has the digest of the empty text and
    matches nothing either. Rows are kept as they are, repeated ones too; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col], canonical(docs[text_col]).alias("__canon"))
    rows = rows.select(id_col, F.length("__canon").cast("long").alias("canon_chars"), F.sha2("__canon", 256).alias("canon_sha256"))
    marks = known.select(F.col("canon_sha256").alias("__digest"), "license_id")
    return rows.join(marks, (F.col("canon_sha256") == F.col("__digest")) & (F.col("canon_chars") > 0), "left").drop("__digest")


def canonical_sql(text: str) -> str:
    """DuckDB expression of ``canonical``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"regexp_replace(lower(regexp_replace({text}, '\\r\\n?', chr(10), 'g')), {quoted(_COPYRIGHT)}, chr(10), 'g')"
    for pattern, single in SPELLINGS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(single)}, 'g')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def scan_sql() -> str:
    """DuckDB SQL of ``scan`` over ``documents`` with the built-in licences."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(KNOWN.items()))
    return f"""
        WITH known AS (SELECT sha256({canonical_sql("t")}) AS digest, min(k) AS license_id FROM (VALUES {values}) AS v(k, t) GROUP BY 1),
        canon AS (SELECT doc_id, {canonical_sql("text")} AS c FROM documents)
        SELECT doc_id, CAST(length(c) AS BIGINT) AS canon_chars, sha256(c) AS canon_sha256, license_id
        FROM canon LEFT JOIN known ON sha256(c) = digest AND length(c) > 0
    """
