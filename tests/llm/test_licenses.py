"""License scan against brute force: planted wordings, all lines of a table, odd rows."""

import re

from astrolabe.llm import licenses
from astrolabe.llm.licenses import LEAST_WORDS, TEMPLATES, Scanner, scan_documents

SF = "/root/testdata/sf0.1"


def test_cues_are_in_every_finding():
    """A wording without any of a template's cues lacks more of its words than a finding may."""
    for words in Scanner().words.values():
        cues = set(Scanner._cues(words))
        assert sum(w not in cues for w in words) < LEAST_WORDS * len(words)


def test_headers_without_the_word_license():
    mpl = "This source code form is subject to the terms of the Mozilla Public Licence v. 2.0"
    assert [(f[0], f[5], f[6]) for f in Scanner().scan(mpl)] == [("MPL-2.0/header", "license", "licence")]
    own = Scanner({"own/terms": "you may copy and share these pages with friends at no charge", "own/short": "to be or"})
    assert [f[0] for f in own.scan("Note: you may copy and share these pages with your friends at no charge!")] == ["own/terms"]
    assert [f[0] for f in own.scan("There: to be or not")] == ["own/short"]


def test_compression_ranks_and_wording_confirms(monkeypatch):
    scanner = Scanner()
    header, statement = TEMPLATES["Apache-2.0/header"], TEMPLATES["Apache-2.0/statement"]
    assert [f[0] for f in scanner.scan(header)] == ["Apache-2.0/header"] and [f[0] for f in scanner.scan(statement)] == ["Apache-2.0/statement"]
    part = scanner.words["Apache-2.0/header"]
    saved = {n: b for b, names in scanner.ranked(part) for n in names}
    assert max(saved, key=saved.get) == "Apache-2.0/header" and saved["Apache-2.0/header"] > saved["Apache-2.0/statement"] > 0
    real = scanner.ranked
    monkeypatch.setattr(scanner, "ranked", lambda p: real(p)[::-1])     # the order decides between wordings that both stand there
    assert "Apache-2.0/statement" in [f[0] for f in scanner.scan(header)]


def test_each_template_is_found_in_text():
    scanner = Scanner()
    for name, text in TEMPLATES.items():
        for wording in (text, text.upper().replace(" ", " \n * "), text.replace(" the ", " this ", 1) if len(text) > 80 else text):
            found = scanner.scan("Some words before of the end. " * 40 + wording + ". And more of the words after it." * 40)
            assert name in [f[0] for f in found], (name, wording, found)
            share = [f for f in found if f[0] == name][0]
            if wording == text:
                assert share[4] == 1.0 and not share[5] and not share[6]


def test_differences_are_exact():
    found = Scanner().scan("Permission is hereby given free of charge, to any person obtaining a full copy of this software and associated "
                           + TEMPLATES["MIT/text"].split("associated ")[1])
    assert [(f[0], f[5], f[6]) for f in found] == [("MIT/text", "granted", "given full")]


def test_two_wordings_of_one_block_and_a_long_block():
    text = "Released under the MIT License. Licensed under CC BY-NC 4.0."
    assert [f[0] for f in Scanner().scan(text)] == ["MIT/statement", "CC-BY-NC-4.0"]
    many = Scanner().scan("Released under the MIT License. " * 300)
    assert len(many) == 300 and {f[0] for f in many} == {"MIT/statement"}


def test_against_all_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {"MIT/statement": "released under the mit license", "Apache-2.0/statement": "licensed under the apache license, version 2.0",
             "GPL-3.0/statement": "licensed under the gnu general public license, version 3", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0"}
    want, with_word = set(), 0
    for r in docs.select("doc_id", "text").collect():
        low = re.sub(r"\s+", " ", r.text or "").lower()
        with_word += "licen" in low
        want |= {(r.doc_id, name) for name, line in plain.items() if line in low}
    got = {(r.id, r.template) for r in scan_documents(docs).collect()}
    assert got == want and len(want) > 20 and len({d for d, _ in want}) == with_word


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "...", None), (None, "Released under the MIT License.", ""), (4, "under the " * 60000, ""),
            (5, "Licensed under CC BY 4.0", ""), (5, "Licensed under CC BY 4.0", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, template string")
    got = sorted((str(r.id), r.nr, r.template) for r in scan_documents(docs).collect())
    assert got == [("5", 0, "CC-BY-4.0"), ("5", 0, "CC-BY-4.0"), ("None", 0, "MIT/statement")]
    assert scan_documents(docs.limit(0)).count() == 0
    assert licenses.LEAST_WORDS < 1


def test_short_notices_of_a_long_block():
    pair = "Licensed under CC BY 4.0; pictures by the people named in this list are licensed under CC BY-SA 4.0."
    assert [f[0] for f in Scanner().scan(pair)] == ["CC-BY-4.0", "CC-BY-SA-4.0"]
    credits = " ".join(f"Photo {k} by author{k * 7919 % 1000}, licensed under CC BY 4.0." for k in range(30))
    assert [f[0] for f in Scanner().scan(credits)] == ["CC-BY-4.0"] * 30
    trailing = TEMPLATES["MIT/text"] + " the software is provided as is without warranty of any kind licensed under cc by 4.0"
    assert [f[0] for f in Scanner().scan(trailing)] == ["MIT/text", "CC-BY-4.0"]


def test_first_words_may_differ():
    notice = ("GNU Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "as published by the Free Software Foundation")
    for text in (notice, "Some words before. " * 30 + notice + ", either version 3 or later." * 3):
        found = Scanner().scan(text)
        assert [(f[0], f[5], f[6]) for f in found] == [("GPL/header", "this program", "")]
        assert round(found[0][4] * 29) == 27 and found[0][2] - found[0][1] == 27
    assert [(f[0], f[6]) for f in Scanner().scan("Licensed (as is) under CC BY 4.0")] == [("CC-BY-4.0", "as is")]


def test_all_templates_in_one_text():
    found = Scanner().scan(". ".join(TEMPLATES.values()))
    assert [f[0] for f in found] == list(TEMPLATES) and all(f[4] == 1.0 and not f[6] for f in found)


def test_every_start_is_tried():
    scanner = Scanner()
    for name, text in TEMPLATES.items():
        want = scanner.words[name]
        lost = int(len(want) * 0.15)
        for at in (0, len(want) // 2, len(want) - lost):
            words = ["then"] * 7 + want[:at] + ["new"] * lost + want[at + lost:] + ["then"] * 7
            found = [f for f in scanner.scan(" ".join(words)) if f[0] == name]
            assert len(found) == 1 and round(found[0][4] * len(want)) == len(want) - lost, (name, at, found)
