import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import licenses as L
from tidewheel.llm.license_texts import BODIES


def tokens(text):
    return re.findall(r"[0-9a-z]+", text.lower())


def longest_common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=10))
def test_alignment(a, b):
    pairs = L.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(a, b)
    if a == b:
        assert len(pairs) == len(a)
    if not any(a.count(x) == 1 == b.count(x) for x in b):
        assert len(pairs) == longest_common(a, b)  # no anchors: exact


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_increasing(values):
    kept = [values[i] for i in L.increasing(values)]
    subsets = ([v for i, v in enumerate(values) if m >> i & 1] for m in range(1 << len(values)))
    best = max((len(x) for x in subsets if x == sorted(set(x))), default=0)
    assert kept == sorted(set(kept)) and len(kept) == best


def found(make_docs, text):
    return {r.license: r for r in L.scan_licenses(make_docs([(1, text)])).collect()}


@pytest.mark.parametrize("text, name", [
    ("foo bar. Released under the MIT License. baz", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("licensed under the GNU Lesser General Public License version 3", "LGPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"),
])
def test_one_license(make_docs, text, name):
    rows = found(make_docs, text)
    assert set(rows) == {name} and rows[name].coverage == 1.0


def test_places_and_noise(make_docs):
    rows = found(make_docs, "the under license " * 40 + "x y released under the MIT License z " + "the mit " * 30)
    assert (rows["MIT"].start_word, rows["MIT"].n_words) == (122, 5)
    assert not found(make_docs, "released the license under some other mit words of no kind " * 3 + "license")
    assert not found(make_docs, "licensed " + "gap " * 60 + "under " + "gap " * 60 + "the mit license")


def test_coverage_of_a_worn_text(make_docs):
    full = "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense"
    worn = full.replace("merge, ", "").replace("publish", "print")
    row = found(make_docs, "aa bb " + worn)["MIT"]
    n = len([t for t in L.TEMPLATES if t[1] == "deal sublicense"][0][2].split())
    assert row.coverage == round((n - 2) / n, 6) and row.start_word == 2
    assert SequenceMatcher(None, full.lower(), worn.lower()).ratio() > 0.8


def test_odd_rows(odd_docs, no_docs, make_docs):
    assert L.scan_licenses(odd_docs).count() == 0 and L.scan_licenses(no_docs).count() == 0
    twice = make_docs([(None, "Released under the MIT License"), (3, "released under the mit license"), (3, "released under the mit license")], clash=True)
    assert sorted((r.doc_id for r in L.scan_licenses(twice).collect()), key=str) == [3, 3, None]


def test_all_stated_licenses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = {r.doc_id for r in docs.where("lower(text) RLIKE 'licen[sc]e'").select("doc_id").collect()}
    assert {r.doc_id for r in L.scan_licenses(docs).where("license <> 'Proprietary'").collect()} == said  # reservations: below


@pytest.mark.parametrize("text, start", [("Foo bar. All rights reserved.", 2), ("Copyright (c) 2020 The Foo Authors. All rights reserved", 6), ("Copyright. All rights reserved", 0)])
def test_rights_reserved(make_docs, text, start):
    rows = found(make_docs, text)
    assert set(rows) == {"Proprietary"} and (rows["Proprietary"].coverage, rows["Proprietary"].start_word) == (1.0, start)
    assert not found(make_docs, "Some rights reserved. All of them are left.")


def test_all_stated_licenses_and_reservations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = {r.doc_id for r in docs.where("lower(text) RLIKE 'licen[sc]e|all rights reserved'").select("doc_id").collect()}
    rows = L.scan_licenses(docs).collect()
    assert {r.doc_id for r in rows} == said
    reserved = {r.doc_id for r in docs.where("lower(text) RLIKE 'all rights reserved'").select("doc_id").collect()}
    assert reserved and {r.doc_id for r in rows if r.license == "Proprietary"} == reserved


@pytest.mark.parametrize("text, name", [
    ("Licensed under the GNU General Public License, version 3. See the license file; version 3 of the license applies.", "GPL-3.0"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License, version 2.0 of the license.", "Apache-2.0"),
])
def test_last_words_again_nearby(make_docs, text, name):
    rows = found(make_docs, text)
    assert set(rows) == {name} and (rows[name].coverage, rows[name].start_word) == (1.0, 0)


def test_statements_side_by_side(make_docs):
    lesser, general = "licensed under the GNU Lesser General Public License version 3 ", "licensed under the GNU General Public License version 3 "
    for text, start in ((lesser + general, 10), (general + lesser, 0), (lesser + lesser + general, 20)):
        rows = found(make_docs, text)
        assert set(rows) == {"LGPL-3.0", "GPL-3.0"} and rows["GPL-3.0"].coverage == rows["LGPL-3.0"].coverage == 1.0
        assert rows["GPL-3.0"].start_word == start
    assert set(found(make_docs, lesser)) == {"LGPL-3.0"}


def matched(window, template, needs):
    """Most words of a common subsequence that holds ``needs``, 0 without one."""
    ways = {(0, frozenset()): 0}  # (words of the window passed, needed words held): matched words
    for w in template:
        for (i, held), n in list(ways.items()):
            for j in range(i, len(window)):
                if window[j] == w:
                    key = (j + 1, held | ({w} & needs))
                    ways[key] = max(ways.get(key, 0), n + 1)
    return max((n for (_, held), n in ways.items() if held == needs), default=0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=24), st.lists(st.integers(0, 4), min_size=2, max_size=6), st.data())
def test_coverage_is_that_of_the_best_window(text, template, data):
    needs = data.draw(st.sets(st.sampled_from(template), max_size=2))
    width = max(len(template), int(L.STRETCH * len(template)))
    most = max((matched(text[a : a + width], template, needs) for a in range(len(text))), default=0)
    named = [" ".join(f"w{x}" for x in y) for y in (text, sorted(needs), template)]
    known = L.compiled((("X", named[1], named[2]),))
    rows = list(L.scan(L.K.tokenize(L.pa.array([named[0]])), known, 0.5))
    assert [r[2] for r in rows] == ([round(most / len(template), 6)] if most >= 0.5 * len(template) else [])
    for _, _, _, first, n in rows:
        assert n <= width and matched(text[first : first + n], template, needs) == most


def test_statements_in_a_long_run():
    text = "licensed under the GNU Lesser General Public License version 3 " * 2000 + "licensed under the GNU General Public License version 3"
    rows = {r[1]: r for r in L.scan(L.K.tokenize(L.pa.array([text])), L.compiled(), 0.8)}
    assert set(rows) == {"LGPL-3.0", "GPL-3.0"} and rows["GPL-3.0"][2:] == (1.0, 20000, 9)


@pytest.mark.parametrize("name, body", BODIES)
def test_whole_texts(make_docs, name, body):
    text = "Copyright 2020 Foo. " + "some other words of the kind " * 5 + body + " and more to the end. " + "of the software " * 20
    rows = found(make_docs, text)
    assert rows[name].coverage == 1.0 and set(rows) == {name}
    start = len(text[: text.index(body)].split())
    assert rows[name].start_word == start


@pytest.mark.parametrize("name, body", [b for b in BODIES if len(b[1].split()) > 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_of_worn_texts(name, body, seed):
    """Patience alignment covers little less than a longest common subsequence, never more."""
    rng = np.random.default_rng(seed)
    worn = []
    for w in body.split():
        u = rng.random()
        worn += [] if u < 0.04 else ["xyz"] if u < 0.08 else [w, "the"] if u < 0.11 else [w]
    words = [L.K.tokenize(L.pa.array([x])).hashes.tolist() for x in (" ".join(worn), body)]
    rows = {r[1]: r for r in L.scan(L.K.tokenize(L.pa.array([" ".join(worn)])), L.compiled(((name, None, body),)), 0.5)}
    most = longest_common(*words) / len(words[1])
    assert most - 0.03 <= rows[name][2] <= most + 1e-6


@pytest.mark.parametrize("text, name", [
    ("// SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("shipped under GPLv3", "GPL-3.0"),
    ("under LGPL v2.1 terms", "LGPL-2.1"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
])
def test_identifier_lines(make_docs, text, name):
    assert set(found(make_docs, text)) == {name}


def test_the_earliest_of_equal_statements(make_docs):
    row = found(make_docs, "released under the MIT License. released under the MIT License")["MIT"]
    assert (row.start_word, row.n_words) == (0, 5)
    body = dict(BODIES)["Zlib"]
    assert found(make_docs, f"{body} {body}")["Zlib"].start_word == 0


def test_no_templates(make_docs):
    assert L.scan_licenses(make_docs([(1, "MIT License")]), templates=()).count() == 0


def test_scan_against_all_windows():
    """The query's rows for notices, by the best common subsequence of every window of every text."""
    rng = np.random.default_rng(8)
    notices = [t for t in L.TEMPLATES if t[1]][:12]
    vocabulary = sorted({w for t in notices for w in tokens(t[2])} | {"foo", "bar", "baz"})
    for _ in range(60):
        text = list(rng.choice(vocabulary, 12))
        own = tokens(notices[rng.integers(len(notices))][2])
        at = int(rng.integers(len(text)))
        text[at:at] = [w for w in own if rng.random() < 0.93]
        for name, needs, notice in notices:
            template, must = tokens(notice), set(tokens(needs))
            width = max(len(template), int(L.STRETCH * len(template)))
            most = max(matched(text[a : a + width], template, must) for a in range(len(text)))
            rows = list(L.scan(L.K.tokenize(L.pa.array([" ".join(text)])), L.compiled(((name, needs, notice),)), L.MIN_COVERAGE))
            assert [r[2] for r in rows] == ([round(most / len(template), 6)] if most >= L.MIN_COVERAGE * len(template) - 1e-9 else [])
