"""Licence rules against a plain loop over the same table, the table itself, and odd rows."""

import re

import pytest

from drawbook.llm.license_rules import BASE, SIGNATURES, WEIGHTS, parse_signatures
from drawbook.llm.licenses import PIECE, RESULTS, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = parse_signatures()


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def by_loop(text):
    words = WORD.findall(lower(text))
    spaced = "".join(f" {w} " for w in words)
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    hits = []
    for rule in RULES:
        for m in re.finditer(rule["pattern"], spaced) if rule["keyword"] in words else ():
            first = spaced[:m.start()].count(" ") // 2
            hits.append((first, first + m[0].count(" ") // 2 - 1, rule["rank"], rule["label"], rule["weight"]))
    outer = [h for h in hits if not any(o != h and o[0] <= h[0] and h[1] <= o[1] and (o[:2] != h[:2] or o[2] < h[2]) for o in hits)]
    outer.sort()
    kept = [h for k, h in enumerate(outer) if not any(0 <= j < len(outer) and outer[j][0] <= h[1] and h[0] <= outer[j][1] and outer[j][2] < h[2] for j in (k - 1, k + 1))]
    base = sorted({label for _, label in places})
    return (len(words), sorted(i for i, _ in places), base, kept, sorted({*base, *(h[3] for h in kept)}), max([h[4] for h in kept] + [0.5 if base else 0.0]))


TEXTS = [
    None, "", "  \t ", "no words of that kind", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by cc by cc-by", "CC BY", "ccby", "mit licensed", "GPLv3 or GPL-2.0+",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: BSD-3-Clause", "see https://creativecommons.org/licenses/by-sa/4.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mité license ü mit license",
    "licensed under the apache license mit license gnu general public license v2 all rights reserved", "KELVIN K mit licenſe mit license",
    "the mit license " * (PIECE + 40), "gnu general public license version 3 cc by 4.0 " * 60, "x" * 300_000 + " mit license",
]


def test_against_a_loop(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, TEXTS[4])], "doc_id long, text string").repartition(3)
    got = {}
    for r in scan_licenses(docs).collect():
        row = (r["lic_words"], r["lic_places"], r["lic_base_labels"], [tuple(h) for h in r["lic_hits"]], r["lic_labels"], r["lic_score"])
        assert got.setdefault(r["doc_id"], row) == row
    assert got.pop(None) == got[4]
    assert got == {k: by_loop(t) for k, t in enumerate(TEXTS)}


def test_kept_labels(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    labels = {r["doc_id"]: r["lic_labels"] for r in scan_licenses(docs).collect()}
    assert labels[3] == [] and labels[4] == ["mit"] and labels[5] == ["apache", "apache-2.0"] and labels[6] == ["gpl", "gpl-3.0"] and labels[7] == ["cc-by", "cc-by-nc"]
    assert labels[12] == ["gpl-2.0", "gpl-3.0"] and labels[13] == ["gpl", "gpl-2.0-or-later"] and labels[14] == ["bsd-3-clause"] and labels[15] == ["cc-by-sa"]


def test_base_phrases_that_overlap_themselves(spark):
    docs = spark.createDataFrame([("a a a b a a",)], "text string")
    assert scan_licenses(docs, rules=[], base=[("a a", "aa"), ("b", "b")]).first()["lic_places"] == [0, 1, 3, 4]


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([("x", 1, 2, 3, 4, "mit license")], "LIC_words string, words int, spaced int, row int, lic_hits_in int, text string")
    out = scan_licenses(docs)
    assert out.columns == ["LIC_words_in", "words", "spaced", "row", "lic_hits_in", "text", *RESULTS]
    assert tuple(out.first())[:5] == ("x", 1, 2, 3, 4)
    assert scan_licenses(docs.limit(0)).count() == 0


def needed_words(pattern):
    """The words of a pattern outside of choices and optional parts."""
    while (shorter := re.sub(r"\(\?:[^()]*\)(?:\?|\{[^}]*\}\??)?", "", pattern)) != pattern:
        pattern = shorter
    return pattern.split()


def test_every_keyword_is_in_every_match():
    lines = [line.split(" | ") for line in SIGNATURES.strip().splitlines() if " | " in line]
    assert len(lines) == len(RULES) > 250 and {r["section"] for r in RULES} == set(WEIGHTS)
    for label, keyword, pattern in lines:
        assert keyword in needed_words(pattern), (label, keyword, pattern)
        assert "," not in label and not re.search(r"\[[^\]]* ", pattern)


@pytest.mark.parametrize("rule", RULES[::7], ids=lambda r: r["label"])
def test_patterns_compile(rule):
    assert re.compile(rule["pattern"]).groups == 0
