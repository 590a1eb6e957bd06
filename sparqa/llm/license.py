"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, lines that only state a copyright dropped, equivalent spellings made
one, punctuation and white space reduced to single spaces. Its digest is then hash-joined to the digests
of known licences. The same form is taken of the whole text and of each of its lines, so a document that is a
licence and a document that carries a notice line are both found; only entire units match, never parts.

Edge cases: a NULL or blank text has no digest and matches nothing; repeated rows yield repeated results;
two known texts with one canonical form give the smaller licence id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparqa.llm.common import stored

#: Equivalent spellings, made one before digests are taken.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("authorised", "authorized"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("http", "https"),
    ("copyright holder", "copyright owner"), ("version", "v"),
)

#: Known licence texts and notices. A user passes a larger table of (license_id, text).
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
            "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
            "THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
            "notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
            "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
            "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
            "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)

_DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
               "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
               "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
               "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
               "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
               "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
               "POSSIBILITY OF SUCH DAMAGE.")
_CLAUSES = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
            "derived from this software without specific prior written permission.")
#: Titles that files put above a short licence.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License", "The BSD License"),
}


def full_texts() -> list[tuple[str, str]]:
    """Whole licences as files hold them: the short ones with titles, the long ones (``licenses/``) with and without what
    follows their terms."""
    bodies = [(i, t) for i, t in KNOWN if i in TITLES and "\n" in t]
    bodies += [(i, t.replace("and/or distribute", "and distribute")) for i, t in bodies if i == "ISC"]
    for name, clauses in (("BSD-2-Clause", _CLAUSES[:3]), ("BSD-3-Clause", _CLAUSES)):
        for marks in (("", "1. ", "2. ", "3. "), ("", "", "", "")):
            bodies.append((name, "\n\n".join([m + c for m, c in zip(marks, clauses, strict=False)] + [_DISCLAIMER])))
    out = [(i, f"{title}\n{reserved}\n{t}") for i, t in bodies for title in ("", *TITLES[i]) for reserved in ("", "All rights reserved.")]
    for f in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(f.stem, text)] + ([(f.stem, head), (f.stem, head + end)] if end else [])
    return out


_SENTENCE = ("a|act|an|any|applies|are|as|at|be|disclaimers?|doctrines?|for|from|he|holders?|if|in|infringements?|interests?|is|it|laws?|licen[sc]es?|"
             "licensed|may|must|not|notices?|on|or|owners?|ownership|permissions?|protected|protection|related|shall|she|should|statements?|status|such|"
             "that|the (?:library|program|software|work)|these|they|this|those|to|treat(?:y|ies)|under|was|we|which|will|with|work|works|you|your")
#: A lower-cased line that only states a copyright; it differs between copies of one licence. A mark and a year, two marks, or a mark
#: and a name to the end of the line, which is not a piece of a sentence.
DATED_LINE = (r"^[ \t]*(?:(?:copyright|\(c\)|©)[ \t:,]*)+(?:by[ \t]+)?[\[<({]?(?:(?:19|20)[0-9]{2}|yyyy|year)\b"
              r"|^[ \t]*copyright[ \t:]*(?:\(c\)|©)")
NOTICE_LINE = (DATED_LINE +
               rf"|^[ \t]*(?:copyright|\(c\)|©)[ \t:]+(?!.*\b(?:{_SENTENCE})\b)(?:\S+[ \t]+){{0,7}}\S*[^\s,;:][ \t\r]*$")


def _plain_lines(text: Column) -> Column:
    """Each line of a text in lower case, without punctuation; lines that only state a copyright are blank."""
    return F.transform(F.split(F.lower(text), "\n"), lambda x: F.when(x.rlike(NOTICE_LINE), F.lit(""))
                       .otherwise(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))))


def _joined(lines: Column) -> Column:
    return F.array_join(F.array_remove(lines, ""), " ")


def _spelled(plain: Column) -> Column:
    """Plain text with equivalent spellings made one. Every word has blanks of its own, so neighbours are both met."""
    t = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form of a text; NULL stays NULL."""
    return _spelled(_joined(_plain_lines(text)))


def _digest(plain: Column) -> Column:
    return F.when(plain != "", F.sha2(_spelled(plain), 256))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; NULL where nothing is left of the text."""
    return _digest(_joined(_plain_lines(text)))


def digest_of(text: str) -> str | None:
    """The digest of a text that is in the driver already, as ``digest`` has it for a column."""
    lines = ["" if re.search(NOTICE_LINE, x) else re.sub(r"[\W_]+", " ", x).strip(" ") for x in text.lower().split("\n")]
    plain = " ".join(x for x in lines if x)
    t = " " + plain.replace(" ", "  ") + " "
    for a, b in SPELLINGS:
        t = t.replace(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ")
    t = t.replace("  ", " ").strip(" ")
    return hashlib.sha256(t.encode()).hexdigest() if plain else None


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *full_texts()], "license_id string, text string")


#: Known digests up to this number are broadcast; a larger table is joined by shuffle.
BROADCAST_LICENSES = 100_000


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, position, digest, license_id).

    One row with unit ``text`` for every document (position -1, licence NULL if its whole text is not a known one), and
    one with unit ``line`` for each line that is a known text, at its 0-based position.
    """
    look = stored(known.select(digest(F.col("text")).alias("digest"), "license_id").filter("digest is not null")
                  .groupBy("digest").agg(F.min("license_id").alias("license_id")), "licenses")
    if look.count() <= BROADCAST_LICENSES:
        look = F.broadcast(look)
    # a line's plain form is made once and serves the line and its text; blank lines match nothing
    plain = docs.select(F.col(key).alias("doc_id"), _plain_lines(F.coalesce(F.col(text), F.lit(""))).alias("_lines"))
    whole = F.array(F.struct(F.lit(-1).alias("position"), _joined(F.col("_lines")).alias("plain")))
    each = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("position"), x.alias("plain"))), lambda u: u["plain"] != "")
    units = plain.select("doc_id", F.explode(F.concat(whole, each)).alias("_u"))
    rows = units.select("doc_id", F.when(F.col("_u.position") < 0, F.lit("text")).otherwise(F.lit("line")).alias("unit"),
                        F.col("_u.position").alias("position"), _digest(F.col("_u.plain")).alias("digest"))
    return (rows.join(look, "digest", "left").filter((F.col("unit") == "text") | F.col("license_id").isNotNull())
            .select("doc_id", "unit", "position", "digest", "license_id"))
