"""License phrases and signature rules."""

import re
import time

import pytest

from rankweave.llm.licenses import BASE, base_places, compiled, detections, licenses
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(text):
    words, found = WORD.findall((text or "").translate(LOW)), []
    for phrase, label in BASE.items():
        parts = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k:k + len(parts)] == parts]
    return len(words), sorted(found)


@pytest.mark.parametrize("text", [
    "Under the MIT License.", "cc by-nc cc_by_nc CC BY NC CC BY NC", "apache license, version 2.0 apache license version 20",
    "under  the\nmit-license under the mit license", "éunder the mit license", "under the mit licenseé", "", "cc by"])
def test_base_places(text):
    assert base_places(text.encode()) == plain_base(text)


@pytest.mark.parametrize("text, labels", [
    ("SPDX-License-Identifier: MIT", {"mit"}), ("spdx-license-identifier: gpl-2.0-or-later\n", {"gpl-2"}),
    ("licensed under the Apache License, Version 2.0 (the", {"apache-2"}), ("the apache license", {"apache"}),
    ("GNU General Public License, version 3.", {"gpl-3"}), ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
    ("Creative Commons Attribution-NonCommercial-ShareAlike", {"cc-by-nc-sa"}), ("CC BY-NC-ND 4.0", {"cc-by-nc-nd"}),
    ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa"}), ("All rights reserved.", {"proprietary"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ("er kam mit der Lizenz", set()), ("unlicensed", set()), ("submit licensees", set())])
def test_rules(text, labels):
    assert {d.label for d in detections(text.translate(LOW))} == labels


def test_a_wider_stronger_detection_suppresses_what_it_holds():
    found = detections("this file is licensed under the gnu general public license version 2 or later")
    assert [(d.label, d.priority) for d in found] == [("gpl-2", 2)]


def test_there_are_hundreds_of_ordered_rules():
    rules = [rule for rule, _ in compiled()[0]]
    assert len(rules) > 200
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_rows(table):
    rows = ODD + [(30, "x Under the MIT license. Under the MIT license"), (31, "cc by nc " * 3000)]
    got = licenses(table(rows, "id", "score", "labels")).collect()
    assert len(got) == len(rows)
    want = {i: plain_base(t) for i, t in rows}
    for r in got:
        n_words, places = want[r.id]
        mine = ",".join(sorted({label for _, label in places}))
        assert (r.n_words, r.n_base, r.base_labels) == (n_words, len(places), mine)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert 0 <= r.score <= 1 and set(filter(None, mine.split(","))) <= set(r.labels.split(","))
    assert licenses(table([])).collect() == []


@pytest.mark.parametrize("text, labels", [
    ("Apache License,\n                Version 2.0", {"apache-2"}),
    ("GNU General Public\n            License\n\n            version 3", {"gpl-3"}),
    (" * the Apache License,\n * Version 2.0", {"apache-2"}), ("# GNU General Public\r\n#   License, version 2", {"gpl-2"}),
    ("// Mozilla Public\n    //License\n    // Version 2", {"mpl-2"}), ("spdx-license-identifier:" + " " * 30 + "mit", {"mit"}),
    ("creative commons attribution" + " " * 40 + "sharealike", {"cc-by-sa"}), ("mit * license", set()), ("mit/license", set())])
def test_a_gap_may_be_of_any_length(text, labels):
    found = detections(text.translate(LOW))
    assert {d.label for d in found} == labels
    assert not labels or text.translate(LOW).endswith(text.translate(LOW)[found[-1].start:found[-1].end])


@pytest.mark.parametrize("text", ["apache" + " " * 500_000, "gnu general public " * 30_000, "licensed under" + "\n * " * 200_000,
                                  ("apache" + " \n" * 500) * 300])
def test_long_gaps_take_time_in_proportion(text):
    start = time.perf_counter()
    detections(text)
    assert time.perf_counter() - start < 10
