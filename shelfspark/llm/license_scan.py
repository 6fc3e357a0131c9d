"""License scans by patience alignment.

A text is aligned with each license template that it may cover. Words that occur once in the
text and once in the template are anchors; the longest run of anchors that rises in both (an
increasing subsequence, found as in patience sorting) is kept, and the gaps between kept
anchors are aligned in the same way, where more words are unique. Matching words next to an
anchor are taken with it. A template's coverage is the share of its words that are aligned.

A long text is no obstacle: windows of one, one and a half and two template lengths slide over
the places of a template's words, and where one holds enough of them, overlapping windows are
aligned, so that other copies of a notice and stray words far away are in no window with it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrow import map_texts

#: Share of a template's words that must be aligned; all of them if it has fewer than so many.
COVERAGE, SHORT = 0.8, 10
#: An aligned stretch is at most so many times as long as its template.
LOOSE = 2
#: Widths of the windows in template lengths, and how many begin in a template length at least.
WIDTHS, STARTS = (1, 1.5, LOOSE), 8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# Notices as public licenses word them, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY-ND-4.0": (
        "CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-NC-SA-4.0": (
        "CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC-ND-4.0": (
        "CC BY-NC-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: Words that tell licenses of like wording apart, besides version numbers. A notice
#: must have those of its template, and none that the template lacks.
DECIDING = frozenset(
    "affero lesser mit apache gnu mozilla eclipse mpl creative sharealike sa noderivatives nd noncommercial nc not".split()
)
VERSION = re.compile(r"v?[0-9](\.[0-9]+)*")
#: A notice right behind such a word is not given.
NEGATIONS = frozenset("not never neither nor without".split())
#: A license that another one's notice contains.
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def decides(word: str) -> bool:
    return word in DECIDING or VERSION.fullmatch(word) is not None


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, in order of their first numbers, whose second numbers
    rise: piles of patience sorting with links to the pile before."""
    tops: list[int] = []
    piles: list[tuple[tuple[int, int], object]] = []
    for pair in pairs:
        at = bisect_left(tops, pair[1])
        link = (pair, piles[at - 1] if at else None)
        tops[at : at + 1] = [pair[1]]
        piles[at : at + 1] = [link]
    chain, link = [], piles[-1] if piles else None
    while link:
        chain.append(link[0])
        link = link[1]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in the text, in the template), rising in both."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:  # instead of recursion, whose depth the input would set
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        often, once = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if once[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(text[a:b], a) if often[w] == 1 and w in place])
        if not anchors:
            continue
        matched += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        gaps += [(i + 1, k, j + 1, l) for (i, j), (k, l) in zip(ends, ends[1:]) if k > i + 1 and l > j + 1]
    return sorted(matched)


def near(pairs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The most pairs whose places in the text lie within ``span``, the first if several."""
    best, first = (0, 0), 0
    for last in range(len(pairs)):
        while pairs[last][0] - pairs[first][0] >= span:
            first += 1
        if last + 1 - first > best[1] - best[0]:
            best = (first, last + 1)
    return pairs[best[0] : best[1]]


class Scanner:
    """The templates, and the vocabulary that tells which of them a text may cover."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words_of(t)) for name, ts in templates.items() for t in ts]
        self.bags = [Counter(words) for _, words in self.templates]
        self.vocabulary = frozenset(w for _, words in self.templates for w in words)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """License, coverage, first and last aligned word (from 0) of each license found: the
        template with the highest coverage, then the most words, then the first place."""
        words = words_of(text) if text else []
        places = [i for i, w in enumerate(words) if w in self.vocabulary]
        hits: list[tuple] = []
        if not places:
            return []
        there = {words[i] for i in places}
        for (name, template), bag in zip(self.templates, self.bags):
            least = self.least(template)
            if sum(n for w, n in bag.items() if w in there) < least:
                continue
            own = [i for i in places if words[i] in bag]
            for covered, start, end in self.hits(words, own, template, bag):
                hits.append((covered * len(template), name, (covered, len(template), -start), start, end))
        # Where two overlap, the notice with more words is meant: one may be worded like a part of another.
        taken: list[tuple] = []
        found: dict[str, tuple] = {}
        for hit in sorted(set(hits), key=lambda h: (-h[0], h[1:])):
            _, name, rank, start, end = hit
            if all(name == other[1] or end < other[3] or start > other[4] for other in taken):
                taken.append(hit)
                if name not in found or rank > found[name][0]:
                    found[name] = (rank, start, end)
        kept = {n: hit for n, hit in found.items() if CONTAINED.get(n) not in found}
        return sorted((name, rank[0], start, end) for name, (rank, start, end) in kept.items())

    def least(self, template: list[str]) -> float:
        return len(template) * (self.coverage if len(template) >= SHORT else 1)

    def hits(self, words: list[str], own: list[int], template: list[str], bag: Counter) -> list[tuple[float, int, int]]:
        """Coverage, first and last place of the alignments that cover enough of a template."""
        least, found, whole = self.least(template), [], set()
        for width in WIDTHS:
            width = math.ceil(width * len(template))
            for first in self.starts(words, own, template, bag, width):
                if any(first - len(template) <= start <= first + width and end >= first for start, end in whole):
                    continue  # holds a complete copy, or begins inside one
                pairs = near(align(words[first : first + width], template), LOOSE * len(template))
                if len(pairs) >= least and self.meant(words, first, pairs, template):
                    start, end = first + pairs[0][0], first + pairs[-1][0]
                    found.append((len(pairs) / len(template), start, end))
                    if len(pairs) == len(template):
                        whole.add((start, end))
        return found

    def meant(self, words: list[str], first: int, pairs: list[tuple[int, int]], template: list[str]) -> bool:
        """Whether the aligned words are this license's notice: they have all deciding words of
        the template, no other stands between them, and nothing before them takes it back."""
        start, end = first + pairs[0][0], first + pairs[-1][0]
        aligned = {first + i for i, _ in pairs}
        has = {words[i] for i in aligned}
        if any(decides(w) and w not in has for w in template):
            return False
        if any(i not in aligned and decides(words[i]) for i in range(start, end + 1)):
            return False
        return NEGATIONS.isdisjoint(words[max(0, start - 2) : start])

    def starts(self, words: list[str], own: list[int], template: list[str], bag: Counter, width: int) -> list[int]:
        """Where windows that hold enough of a template's words begin: those that hold most,
        those at a first word of the template, and others at short distances."""
        least, step, heads = self.least(template), max(1, len(template) // STARTS), set(template[:3])
        inside, have, end, held = Counter(), 0, 0, []
        for first in own:
            while end < len(own) and own[end] < first + width:
                word = words[own[end]]
                inside[word] += 1
                have += inside[word] <= bag[word]
                end += 1
            held.append(have)
            word = words[first]
            have -= inside[word] <= bag[word]
            inside[word] -= 1
        chosen, last, rose = [], -step, True
        for i, n in enumerate(held):
            rose = n > held[i - 1] or (rose and n == held[i - 1]) if i else True
            if n >= least:
                peak = rose and (i + 1 == len(held) or held[i + 1] < n)
                if peak or words[own[i]] in heads or own[i] - last >= step:
                    chosen.append(own[i])
                    last = own[i]
        return chosen


def license_scan(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    coverage: float = COVERAGE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id and licenses of each row: an array of (license, coverage, first_word, last_word),
    in order of the names, empty where none is found. Of notices that overlap the one with the
    most aligned words counts, on a tie the first by name.

    Words are runs of letters and digits, lower-cased (version numbers keep their points). A
    null text counts as empty. Texts are read whole, of any length. A notice whose deciding words
    (names, clauses, versions) differ from the template's, or that stands behind a negation, is
    not found. A row per input row, repeated rows included, none for an empty table; other
    columns are not read.
    """
    scanner = Scanner(templates, coverage)
    names = ("license", "coverage", "first_word", "last_word")
    record = pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.int64(), pa.int64()))))

    def of(batch):
        found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
        records = [[dict(zip(names, f)) for f in own] for own in found]
        return {"doc_id": batch.column("doc_id"), "licenses": pa.array(records, pa.list_(record))}

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    entry = "array<struct<license string, coverage double, first_word long, last_word long>>"
    return map_texts(rows, of, f"doc_id {kind}, licenses {entry}")

