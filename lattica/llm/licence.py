"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case, lines that state a copyright removed, every
run of other characters than letters and digits as one space, and equivalent spellings as one.
The digest of the whole form is looked up among digests of known licences, made by the same
expression. The known table is a parameter of a few texts and is broadcast. A text whose digest
is not known is looked up once more with copyright lines removed that stand behind comment marks
or say "portions"; the digest that is returned stays that of the canonical form.

Defined results: null and empty texts, and texts of copyright lines alone, have the digest of
the empty form, which is no licence; a null id passes through; equal rows are treated alike;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import whole

#: Spellings that count as one, from the public guidelines on matching licences.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "percent": "per cent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull",
}
#: A line that states a copyright: the word with a sign, year, placeholder or "by" behind it, or a year in the line; a licence's own line that happens to begin with the word has none.
_STATED = r"(copyright[ \t:]*(\(c\)|©|<|\[|\{|[0-9]|by[ \t])|copyright[ \t][^\n]*[0-9]{4}|\(c\)|©|all rights reserved)[^\n]*"
COPYRIGHT = rf"(^|\n)[ \t]*{_STATED}"
#: Such lines behind comment marks too.
MARKED = rf"(^|\n)[^\p{{L}}\p{{N}}\n]*(portions[ \t]+)?{_STATED}"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Public licence texts and notices (name, text).
KNOWN = [
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holder>\n\n{_MIT}"),
    ("ISC", f"ISC License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
]
#: Full texts of common licences, some with and without title, numbers or appendix.
FULL = [(r["licence"], r["text"]) for r in json.loads(Path(__file__).with_name("licences.json").read_text(encoding="utf-8"))]


def canonical(text: Column, removed: str = COPYRIGHT) -> Column:
    out = F.regexp_replace(F.lower(text), removed, "$1")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word with spaces of its own
    for said, meant in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {said.replace(' ', '  ')} "), F.lit(f" {meant.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def scan(docs: DataFrame, known: list[tuple[str, str]] = [*KNOWN, *FULL], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B006
    """(id, digest, licence): the digest of the canonical whole text, and the known licence that has it, or null."""
    if len(known) > 100_000:
        raise ValueError("too many known texts to broadcast")
    texts = docs.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in known])).alias("k"))

    def names(removed: str, digest: str, licence: str) -> DataFrame:
        return F.broadcast(texts.select(F.sha2(canonical(F.col("k.text"), removed), 256).alias(digest), "k.licence").groupBy(digest).agg(F.min("licence").alias(licence)))

    text = whole(text_col)
    marked = F.when(F.lower(text).rlike(MARKED), F.sha2(canonical(text, MARKED), 256))
    out = docs.select(F.col(id_col).alias("id"), F.sha2(canonical(text), 256).alias("digest"), marked.alias("marked"))
    out = out.join(names(COPYRIGHT, "its_digest", "whole"), F.col("digest") == F.col("its_digest"), "left").join(names(MARKED, "its_marked", "behind"), F.col("marked") == F.col("its_marked"), "left")
    return out.select(F.col("id").alias(id_col), "digest", F.coalesce("whole", "behind").alias("licence"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """scan() of documents as DuckDB SQL, with the texts of known alone and without the second look behind comment marks."""

    def form(x: str) -> str:
        x = f"regexp_replace(lower({x}), {_quoted(COPYRIGHT)}, '\\1', 'g')"
        x = f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        x = f"(' ' || replace({x}, ' ', '  ') || ' ')"
        for said, meant in SPELLINGS.items():
            x = f"replace({x}, {_quoted(' ' + said.replace(' ', '  ') + ' ')}, {_quoted(' ' + meant.replace(' ', '  ') + ' ')})"
        return f"trim(replace({x}, '  ', ' '))"

    rows = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in known)
    return (
        f"WITH known AS (SELECT sha256({form('text')}) AS digest, min(licence) AS licence FROM (VALUES {rows}) AS t(licence, text) GROUP BY 1), "
        f"scanned AS (SELECT doc_id, sha256({form("coalesce(text, '')")}) AS digest FROM documents) "
        "SELECT doc_id, digest, licence FROM scanned LEFT JOIN known USING (digest)"
    )
