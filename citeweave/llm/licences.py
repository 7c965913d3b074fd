"""License scan: whole texts looked up by the digest of their canonical form.

The canonical form has small letters, one spelling for words spelt in several ways, no
copyright notices, and single blanks for runs of anything but letters and digits. Its
SHA-256 is joined with the digests of known licences; nothing is compared in part.

Known texts come as a table (``licence, text``). ``known_texts`` gives the full texts that
lie in ``licence_texts`` (with and without their titles and appendices), the two texts
and the statements of ``KNOWN``, and the usual notices of every version that ``notices``
names; callers add their own. A licence that is only some lines of a longer document is
not found, unless each of these lines is a known text of its own.

Defined cases: null, empty and wordless texts have an empty canonical form, a null
digest and match nothing. A notice within a line stays, and one that goes over several
lines loses its first, so a copy that wraps a notice otherwise is not found. A text known under several names gives the smallest name.
Repeated rows are each looked up. Columns besides the id and text are not looked at.
Empty tables give empty results; texts may be of any length.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known digests up to this many rows are broadcast.
BROADCAST_ROWS = 100_000

# Spellings that license texts use for the same word.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "organisation": "organization",
    "organisations": "organizations",
    "authorised": "authorized",
    "recognised": "recognized",
    "merchantibility": "merchantability",
    "noninfringement": "non infringement",
    "whilst": "while",
    "favour": "favor",
    "honour": "honor",
    "programme": "program",
    "https": "http",
    "gplv3": "gpl v3",
    "v2": "version 2",
    "v3": "version 3",
}

# Public statements and licence texts, by name.
KNOWN = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "FSFAP": (
        "Copying and distribution of this file, with or without modification, are permitted"
        " in any medium without royalty provided the copyright notice and this notice are"
        " preserved. This file is offered as-is, without any warranty."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose"
        " with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE"
        " AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
        " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE"
        " FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
        " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF"
        " CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION"
        " WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}

# Full texts, one file for each licence.
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
# Titles under which copies of a text go; files hold the first one, or none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Unlicense": ["The Unlicense"],
}
# After these lines come appendices that copies often lack.
ENDS = ("END OF TERMS AND CONDITIONS",)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
    " except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
    " in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License"
    " for the specific language governing permissions and limitations under the License."
)
MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a"
    " copy of the MPL was not distributed with this file, You can obtain one at"
    " https://mozilla.org/MPL/2.0/."
)
GNU_HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of"
    " the {name} as published by the Free Software Foundation, {version}. This {what} is"
    " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
    " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for"
    " more details. You should have received a copy of the {name} along with this {what}. If"
    " not, see <https://www.gnu.org/licenses/>."
)
# Names and versions of the GNU licences, and of the Creative Commons ones.
GNU = {
    "GPL": {"GNU General Public License": ["1.0", "2.0", "3.0"]},
    "LGPL": {
        "GNU Library General Public License": ["2.0"],
        "GNU Lesser General Public License": ["2.1", "3.0"],
    },
    "AGPL": {"GNU Affero General Public License": ["1.0", "3.0"]},
}
CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}

# Used by the registered SQL only: it also drops lines of a licence that begin so.
COPYRIGHT_LINE = r"(?im)^[ \t#*/;-]*(copyright\b|\(c\)|©)[^\n]*$"
# Of the lines that begin so only notices are dropped: a line with a second mark or a year,
# and, at the head of a text, one that names a holder.
_MARK = r"(?:copyright|\(c\)|©)"
_HEAD = r"[ \t#*/;-]*"
_YEAR = r"[\[<{(]?(?:year|yyyy|[0-9]{4})\b"
_NO_HOLDER = (
    r"(?:notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|rights?|treaty|and|or|in|is|are)"
)
NOTICE = (
    rf"(?im)^{_HEAD}(?:©|{_MARK}[ \t:,]*(?:{_MARK}|{_YEAR}))[^\n]*$"
    rf"|\A\s*{_HEAD}{_MARK}(?![\w])(?![ \t]*{_NO_HOLDER}\b)[^\n]*$"
)
NOT_IN_WORDS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; spellings are replaced whole word by whole word."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), NOTICE, "\n")
    # Two blanks between words, so that neighbouring words don't share one.
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(plain), NOT_IN_WORDS, "  "), F.lit(" "))
    for word, same in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {same} "))
    return F.replace(F.trim(out), F.lit("  "), F.lit(" "))


def digest(text: Column) -> Column:
    # By way of an array, or the form is worked out once to be compared and once to be hashed.
    forms = F.array(canonical(text))
    return F.transform(forms, lambda form: F.when(form != "", F.sha2(form, 256)))[0]


def _gnu_notices() -> list[tuple[str, str]]:
    out = []
    for short, names in GNU.items():
        for name, versions in names.items():
            for full in versions:
                number, label = full.removesuffix(".0"), f"{short}-{full}"
                later = f"either version {number} of the License, or (at your option) any later version"
                for version, kind in ((f"version {number}", label), (later, f"{label}-or-later")):
                    for what in ("program", "library", "file"):
                        text = GNU_HEADER.format(what=what, name=name, version=version)
                        out.append((f"{kind} notice", text))
                    if kind != label:
                        version = f"version {number} or later"
                    out.append((f"{kind} notice", f"This work is licensed under the {name}, {version}."))
                    out.append((f"{kind} notice", f"Licensed under the {name}, {version}."))
    return out


def notices() -> list[tuple[str, str]]:
    """``licence, text`` of the usual notices of licences, for all their versions."""
    out = [("Apache-2.0 notice", APACHE_HEADER), ("MPL-2.0 notice", MPL_HEADER), *_gnu_notices()]
    for v in ("1.0", "1.1", "2.0"):
        out.append((f"Apache-{v} notice", f"Licensed under the Apache License, Version {v}."))
        out.append((f"MPL-{v} notice", f"Licensed under the Mozilla Public License, Version {v}."))
    named = {"MIT": "MIT", "ISC": "ISC", "BSD-2-Clause": "BSD 2-Clause", "BSD-3-Clause": "BSD 3-Clause"}
    for short, name in named.items():
        for verb in ("Released", "Licensed"):
            out.append((f"{short} notice", f"{verb} under the {name} License."))
    for short, name in CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            kind = f"CC-{short}-{v} notice"
            out.append((kind, f"Licensed under CC {short} {v}."))
            port = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            for what in (f"Creative Commons {name} {v} License", f"Creative Commons {name} {v} {port} License"):
                out.append((kind, f"This work is licensed under a {what}."))
                out.append((kind, f"Licensed under the {what}."))
    return out


def full_texts() -> list[tuple[str, str]]:
    """``licence, text`` of the texts in ``FOLDER`` as they stand, and as copies vary them."""
    out = []
    for file in sorted(os.listdir(FOLDER)):
        name = file.removesuffix(".txt")
        with open(os.path.join(FOLDER, file), encoding="utf-8") as opened:
            text = opened.read()
        bodies = [text]
        for end in ENDS:
            head, found, _ = text.partition(end)
            bodies += [head, head + found] if found else []
        if name in TITLES:
            body = text.strip().removeprefix(TITLES[name][0])
            bodies += [body, *(f"{title}\n{body}" for title in TITLES[name])]
        out += [(name, body) for body in bodies]
    return out


def known_texts(spark: SparkSession) -> DataFrame:
    rows = [*KNOWN.items(), *notices(), *full_texts()]
    return spark.createDataFrame(rows, "licence string, text string")


def scan(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, digest, licence`` per row; ``licence`` is null where no known text equals."""
    named = known.select(digest(F.col("text")).alias("digest"), "licence")
    named = named.where("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    # A key that is never null: else inner joins filter on it, and work every digest out twice.
    key = F.coalesce(digest(F.col(text_col)), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("digest"))
    found = rows.join(named, "digest", "left")
    return found.select("doc_id", F.nullif("digest", F.lit("")).alias("digest"), "licence")


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every non-blank line of every document as a text of its own: ``doc_id, line, text``."""
    lines = docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "text")
    )
    return lines.where(F.trim("text") != "")
