"""The licence texts and notices that the registered query knows."""

import re
import textwrap

from citeweave.llm import licences


def _scanned(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licences.scan(table, licences.known_texts(spark)).collect()
    return [r["licence"] for r in sorted(found, key=lambda r: r["doc_id"])]


def _text(name):
    with open(f"{licences.FOLDER}/{name}.txt", encoding="utf-8") as opened:
        return opened.read()


def test_whole_texts_and_notices_of_other_versions_are_known(spark):
    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "CC-BY-SA-4.0"]
    mit = _text("MIT").removeprefix("MIT License").replace("<year> <copyright holders>", "2021 Someone Else")
    texts = [*map(_text, names), mit, "The MIT License (MIT)\n" + mit, _text("MIT") + " or not"]
    texts += ["This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY 4.0."]
    texts += ["Released under the MIT License.", "Licensed under CC BY-NC 4.0."]
    want = [*names, "MIT", "MIT", None, "GPL-2.0 notice", "CC-BY-4.0 notice", "MIT notice", "CC-BY-NC-4.0 notice"]
    assert _scanned(spark, texts) == want


def test_no_text_is_known_under_two_licences(spark):
    forms = licences.known_texts(spark).select("licence", licences.digest("text").alias("d"))
    assert forms.where("d is null").count() == 0
    assert forms.groupBy("d").agg({"licence": "min"}).count() == forms.distinct().count()


WIDTHS = (40, 60, 72, 76, 80, 100)


def _wrapped(text, width):
    """The text with its paragraphs filled anew; lines that hold notices stay as they are."""
    out = []
    for lines in text.split("\n\n"):
        part = []
        for line in [*lines.split("\n"), None]:
            if line is None or re.match(licences.NOTICE, line) or "Copyright (C)" in line:
                out.append(textwrap.fill(" ".join(part), width, break_long_words=False, break_on_hyphens=False))
                out += [] if line is None else [line]
                part = []
            else:
                part.append(line)
    return "\n".join(out)


def test_known_texts_at_several_wrap_widths(spark):
    rows = list(dict.fromkeys([*licences.KNOWN.items(), *licences.full_texts()]))
    texts = [(name, _wrapped(text, w)) for name, text in rows for w in WIDTHS]
    assert _scanned(spark, [t for _, t in texts]) == [name for name, _ in texts]


def test_only_notices_are_dropped(spark):
    given = "Permitted provided the\ncopyright notice is kept.\n(c) You must not\nCOPYRIGHT HOLDERS BE LIABLE"
    texts = [given, given.replace("\n", " "), "Copyright 2020 X\n" + given, "# Copyright (c) X\n" + given]
    texts += ["Copyright The Owners\n" + given, given.replace("(c) You must not", "(c) You may")]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["f"] for r in table.select("doc_id", licences.canonical("text").alias("f")).orderBy("doc_id").collect()]
    assert got[0].split() == "permitted provided the copyright notice is kept c you must not copyright holders be liable".split()
    assert got[1:5] == [got[0]] * 4 and got[5] != got[0]
