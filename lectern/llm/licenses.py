"""Licence scan (native): canonical digests of entire texts, hash-joined to known licences.

A text is cut into lines; copyright lines (a mark, a year or a placeholder after the word) go;
the lines that remain are joined by blanks, lower-cased, everything but letters and digits becomes
one blank, equivalent spellings get one form, and the digest is taken of the whole, so it does not
depend on where lines break. The same is done to every line by itself, so notices inside a document
are found too. Known texts pass through the same expression.

Distribution: one pass over the texts; the known digests (a fixed list, some hundred rows) are
broadcast, and one small row a document, not its text, is shuffled.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_frame, table

#: A line that only states who holds the copyright.
COPYRIGHT = (
    r"^[^\p{L}\p{N}©(]*((portions )?copyright *(\(c\)|©|:|<|\[|[0-9]{4})|©|\(c\) *[\p{L}\p{N}<\[])|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
)
#: Equivalent spellings: pattern and replacement with \1 groups, in this order.
SPELLINGS = [
    (r"\blicenc(e|es|ed|ing)\b", r"licens\1"),
    (r"\b([a-z]{3,})is(ation|ations|e|ed|es|ing)\b", r"\1iz\2"),
    (r"\b(fav|behavi|hon|col|lab)our", r"\1or"),
    (r"\b(sub|non) ([a-z])", r"\1\2"),
    (r"\bcopyright holder", r"copyright owner"),
    (r"\bwhilst\b", r"while"),
    (r"\bv(er)? ?([0-9])", r"version \2"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{0}
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Short texts by licence; ``known_texts`` adds the files and the notices.
TEXTS = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("0BSD", _ISC.format(".")),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies.")),
]
#: Complete texts as published, one file a licence, and the titles they are also headed by.
FILES = Path(__file__).with_name("license_texts")
TITLES = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License"}
#: First lines that name their licence by themselves.
FIRST_LINES = [
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Names that notices use.
NAMES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0-only", "GNU General Public License, version 2"), ("GPL-3.0-only", "GNU General Public License, version 3"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"), ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("ISC", "ISC License"),
]
LEADS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under"]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text): complete texts, each also with its title, without what follows the terms,
    with bare bullets for numbers (BSD) and with the other scheme of its addresses."""
    out = [*TEXTS, *((f.stem, f.read_text(encoding="utf-8")) for f in sorted(FILES.glob("*.txt")))]
    out += [(i, t[: m.end()]) for i, t in out if (m := re.search(r"END OF TERMS AND CONDITIONS", t))]
    out += [(i, t[: m.start()]) for i, t in out if (m := re.search(r"END OF TERMS AND CONDITIONS$", t))]
    out += [(i, re.sub(r"(?m)^( *)[123]\.", r"\1*", t)) for i, t in out if i.startswith("BSD-")]
    out += [(i, f"{TITLES[i]}\n{t}") for i, t in out if i in TITLES]
    return out + [(i, t.replace(a, b)) for i, t in out for a, b in (("http:", "https:"), ("https:", "http:")) if a in t]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): the full texts, telling first lines, and every lead with every name, with and without the article."""
    notices = [(i, f"{lead} {the}{name}") for i, name in NAMES for lead in LEADS for the in ("", "the ")]
    return [*full_texts(), *FIRST_LINES, *notices]


def is_copyright_line(line: Column) -> Column:
    return F.lower(line).rlike(COPYRIGHT)


def canonical(text: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return out


def canonical_line(line: Column) -> Column:
    return F.when(is_copyright_line(line), F.lit("")).otherwise(canonical(line))


def split_lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n", -1)


def whole(lines: Column) -> Column:
    """Lines as one canonical text. A line that begins with (c) in a text with a (b) is an item of a list."""
    lettered = F.array_join(lines, " ").rlike(r"\([bB]\)")
    item = lambda x: lettered & x.rlike(r"^\s*\([cC]\)")
    return canonical(F.array_join(F.filter(lines, lambda x: ~is_copyright_line(x) | item(x)), " "))


def head(line: Column) -> Column:
    """The first three letters or digits. No spelling rule changes them, but for ``v`` before a
    number; so a line whose head begins no known text cannot match and is not worked on."""
    return F.regexp_extract(F.lower(line), r"[\p{L}\p{N}]{1,3}", 0)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, digest; one row a digest (the first licence by name)."""
    rows = rows_frame(spark, known_texts() if known is None else known, license="string", text="string")
    return rows.select("license", whole(split_lines(F.col("text"))).alias("canonical")).groupBy("canonical").agg(F.min("license").alias("license")).select(
        F.sha2("canonical", 256).alias("digest"), "license", head(F.col("canonical")).alias("head"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_known: int = 100_000) -> DataFrame:
    """One row per row: id, license (of the entire text, else null), line_licenses (the distinct
    licences of single lines, sorted, comma-separated), license_lines, copyright_lines.

    Null and empty texts match nothing; repeated rows stay repeated, null ids stay null; texts of any length are read
    whole; an empty table gives an empty result. Other columns are dropped. Up to ``broadcast_known`` digests are broadcast, and only texts and lines that
    begin like one of them are worked on; more are joined by a shuffle, without that short cut and with equal results."""
    few = known.limit(broadcast_known + 1).count() <= broadcast_known
    heads = sorted(r[0] for r in known.select("head").distinct().collect()) if few else []
    begins = F.create_map(*[F.lit(x) for h in heads for x in (h, True)]) if heads else F.expr("map('', false)")

    def may_match(line: Column) -> Column:
        h = head(line)
        if not few:
            return h != ""
        return h.startswith("v") | F.coalesce(F.element_at(begins, h), F.lit(False))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), split_lines(text).alias("lines")).select(
        "id", "row", "lines", F.size(F.filter("lines", is_copyright_line)).cast("long").alias("copyright_lines"),
        F.try_element_at(F.filter("lines", lambda x: (head(x) != "") & ~is_copyright_line(x)), F.lit(1)).alias("first"))
    entire = F.when(may_match(F.col("first")), F.sha2(whole(F.col("lines")), 256))
    single = F.transform(F.filter("lines", may_match), lambda x: F.struct(
        F.lit(False).alias("entire"), F.sha2(canonical_line(x), 256).alias("digest")))
    table_ = known.select("digest", "license")
    units = rows.select("id", "row", "copyright_lines", F.inline(F.concat(
        F.array(F.struct(F.lit(True).alias("entire"), entire.alias("digest"))), single)))
    found = units.join(F.broadcast(table_) if few else table_, "digest", "left").where("entire or license is not null")
    return (
        found.groupBy("id", "row")
        .agg(
            F.max(F.when(F.col("entire"), F.col("license"))).alias("license"),
            F.array_join(F.sort_array(F.collect_set(F.when(~F.col("entire"), F.col("license")))), ",").alias("line_licenses"),
            F.sum((~F.col("entire")).cast("long")).alias("license_lines"),
            F.max("copyright_lines").alias("copyright_lines"), F.sum(F.col("entire").cast("long")).alias("copies"))
        .select(
            F.col("id").alias(id_col), "license", "line_licenses", F.expr("license_lines div copies").alias("license_lines"),
            "copyright_lines", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .drop("copy")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, line_licenses, license_lines, copyright_lines for every document (see ``scan``)."""
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_canonical(line: str) -> str:
    out = f"trim(regexp_replace(lower({line}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def _sql_whole(text: str) -> str:
    """The lines of a text, but for copyright lines, as one canonical text."""
    lines = f"string_split_regex({text}, '\\r\\n|\\r|\\n')"
    lettered = f"regexp_matches(array_to_string({lines}, ' '), '\\([bB]\\)')"
    kept = f"list_filter({lines}, lambda x: NOT regexp_matches(lower(x), '{COPYRIGHT}') OR ({lettered} AND regexp_matches(x, '^\\s*\\([cC]\\)')))"
    return _sql_canonical(f"array_to_string({kept}, ' ')")


_KNOWN = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_texts())
OP3_SQL = f"""
WITH given(license, text) AS (VALUES {_KNOWN}),
known AS (SELECT sha256({_sql_whole("text")}) AS digest, min(license) AS license FROM given GROUP BY 1),
split AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lined AS (
  SELECT row, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM split),
seen AS (
  SELECT row, regexp_matches(lower(line), '{COPYRIGHT}') AS mark, sha256({_sql_canonical("line")}) AS digest FROM lined),
found AS (
  SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(license) AS license_lines, count(*) FILTER (mark) AS copyright_lines
  FROM (SELECT row, mark, CASE WHEN NOT mark THEN known.license END AS license FROM seen LEFT JOIN known USING (digest)) GROUP BY row)
SELECT doc_id, license, coalesce(line_licenses, '') AS line_licenses, coalesce(license_lines, 0) AS license_lines,
  CAST(coalesce(copyright_lines, 0) AS BIGINT) AS copyright_lines
FROM split LEFT JOIN known ON digest = sha256({_sql_whole("text")}) LEFT JOIN found USING (row)
"""
