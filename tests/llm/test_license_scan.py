"""Patience alignment and the licenses it finds."""

import random

from shelfspark.llm.license_scan import TEMPLATES, Scanner, align, decides, license_scan, rising, words_of
from tests.llm.tables import empty_table, hard_cases, hard_table


def test_rising_is_longest():
    pick = random.Random(3)
    for _ in range(200):
        order = pick.sample(range(12), 9)
        pairs = list(enumerate(order))
        best = 0
        for chosen in range(1 << 9):
            own = [order[i] for i in range(9) if chosen >> i & 1]
            best = max(best, len(own)) if own == sorted(own) else best
        found = rising(pairs)
        assert len(found) == best and [b for _, b in found] == sorted(b for _, b in found)


def test_alignment_rises_and_matches():
    template = words_of(TEMPLATES["MIT"][-1])
    pick = random.Random(5)
    for _ in range(50):
        text = [w for w in template if pick.random() > 0.1]
        kept = len(text)
        for _ in range(5):
            text.insert(pick.randrange(len(text)), pick.choice(["noise", "the", "software"]))
        pairs = align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(pairs) >= 0.8 * kept


def test_each_template_is_found_in_prose():
    scanner = Scanner()
    for name, texts in TEMPLATES.items():
        for text in texts:
            found = scanner.scan(f"Some words of prose about the license. {text.upper()}. And of the use of it " + "x " * 500)
            assert [f[0] for f in found] == [name] and found[0][1] == 1.0


PROSE = "the owner of this house went to the market and any of the people in it had to be at the door or in a hall of stone".split()


def prose(pick, words):
    return " ".join(pick.choice(PROSE) for _ in range(words))


def test_two_copies_in_long_prose():
    scanner, pick = Scanner(), random.Random(7)
    for name, texts in TEMPLATES.items():
        for text in texts:
            for between in (0, 3, 40, 700):
                parts = (prose(pick, 900), text, prose(pick, between), text, prose(pick, 900))
                found = scanner.scan(". ".join(p for p in parts if p))
                assert [f[0] for f in found] == [name] and found[0][1] == 1.0
                assert found[0][3] - found[0][2] == len(words_of(text)) - 1


def test_edited_notices_in_long_prose():
    scanner, pick = Scanner(), random.Random(11)
    for name, texts in TEMPLATES.items():
        template = words_of(texts[-1])
        if len(template) < 20:
            continue
        for _ in range(20):
            def edited():
                free = [i for i, w in enumerate(template) if not decides(w)]
                gone = set(pick.sample(free, len(template) // 10))
                kept = [w for i, w in enumerate(template) if i not in gone]
                for _ in range(3):
                    kept.insert(pick.randrange(len(kept)), "edited")
                return " ".join(kept)
            stray = " ".join(pick.sample(template, 2))
            text = " ".join([prose(pick, 300), stray, prose(pick, 200), edited(), prose(pick, 100), edited(), prose(pick, 300), stray])
            assert name in [f[0] for f in scanner.scan(text)]


def test_a_stray_word_far_from_an_edited_notice():
    template = words_of(TEMPLATES["MIT"][-1])
    assert template.count("permission") == 1
    text = "permission " + "the of to and " * 100 + " ".join(template[2:])
    assert [f[0] for f in Scanner().scan(text)] == ["MIT"]


GPL = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License "
    "as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
SIBLINGS = {
    GPL.format("program", "", 3): ["GPL-3.0"],
    GPL.format("library", "", 3): ["GPL-3.0"],
    GPL.format("program", "", 2): ["GPL-2.0"],
    GPL.format("program", "Affero ", 3): ["AGPL-3.0"],
    GPL.format("library", "Lesser ", 2.1): ["LGPL-2.1"],
    GPL.format("program", "Lesser ", 3): ["LGPL-3.0"],
    GPL.format("program", "", 4): [],
    CC.format(""): ["CC-BY-4.0"],
    CC.format("-ShareAlike"): ["CC-BY-SA-4.0"],
    CC.format("-NoDerivatives"): ["CC-BY-ND-4.0"],
    CC.format("-NonCommercial"): ["CC-BY-NC-4.0"],
    CC.format("-NonCommercial-ShareAlike"): ["CC-BY-NC-SA-4.0"],
    CC.format("-NonCommercial-NoDerivatives"): ["CC-BY-NC-ND-4.0"],
    CC.format("").replace("4.0", "3.0"): [],
    "Licensed under CC BY 4.0": ["CC-BY-4.0"],
    "CC BY-SA 4.0": ["CC-BY-SA-4.0"],
    "Licensed under CC BY-NC 4.0": ["CC-BY-NC-4.0"],
    "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0"],
    "This is not licensed under the MIT License": [],
    "Licensed under the Apache License, Version 1.1": [],
}


def test_like_notices_are_told_apart():
    scanner, pick = Scanner(), random.Random(2)
    for text, names in SIBLINGS.items():
        for before, after in ((0, 0), (200, 200)):
            whole = ". ".join((prose(pick, before), text, prose(pick, after)))
            assert [f[0] for f in scanner.scan(whole)] == names, text


def test_clauses_of_one_family():
    two, three = TEMPLATES["BSD-2-Clause"][0], TEMPLATES["BSD-3-Clause"][0]
    scanner = Scanner()
    assert [f[0] for f in scanner.scan(two)] == ["BSD-2-Clause"]
    assert [f[0] for f in scanner.scan(f"{two}: keep this list. {three}.")] == ["BSD-3-Clause"]


def common(a, b):
    """Length of the longest common subsequence, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_coverage_next_to_full_alignment():
    """Of edited notices nearly as much is aligned as by trying all alignments, never more."""
    pick = random.Random(9)
    for texts in TEMPLATES.values():
        template = words_of(texts[-1])
        for _ in range(12):
            text = [w for w in template if pick.random() > 0.08]
            for _ in range(3):
                text.insert(pick.randrange(len(text) + 1), pick.choice(["noise", "the", "of", "license"]))
            found, best = len(align(text, template)), common(text, template)
            assert 0.85 * best <= found <= best


def test_nothing_is_found_in_prose():
    assert Scanner().scan("He was licensed to work under the general terms of the public house " * 50) == []
    assert Scanner().scan("Licensed under the SAME License") == []


def test_hard_cases(spark):
    rows = license_scan(hard_table(spark)).collect()
    assert len(rows) == len(hard_cases()) and all(r.licenses == [] for r in rows)
    assert license_scan(empty_table(spark)).collect() == []
    one = spark.createDataFrame([(1, "a\nReleased under the MIT License. Licensed under CC BY-NC 4.0.", 0)], "doc_id long, text string, licenses int")
    (row,) = license_scan(one).collect()
    assert [(x.license, x.first_word, x.last_word) for x in row.licenses] == [("CC-BY-NC-4.0", 6, 11), ("MIT", 1, 5)]
