import re

import duckdb
import pytest

from evalkiln.llm import licences


def grams(text):
    words = re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def units(text):
    """Lines, paragraphs, up to three sentences in a row, and the whole, without comment marks."""
    text = re.sub(r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|#+|//+|--+|;+|%+|<!--|>+|\|)[ \t]*", r"\1", text)
    s = [x for x in re.split(r"[.;:!?][ \t\r\n]+|\n[ \t\r]*\n", text) if re.search("[A-Za-z0-9]", x)]
    return text.split("\n") + re.split(r"\n[ \t\r]*\n", text) + [text] + [" ".join(s[i : i + k]) for i in range(len(s)) for k in (1, 2, 3)]


def windows(text, template):
    """All windows of the template's number of words that start with one of its bigrams, without comment marks."""
    split = lambda x: re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))
    w, size = split(re.sub(r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|#+|//+|--+|;+|%+|<!--|>+|\|)[ \t]*", r"\1", text)), len(split(template))
    return [" ".join(w[i : i + size]) for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" in grams(template)]


def brute(text):
    """Every template against every unit and window, with no rule of size and no anchors."""
    out = []
    for name, t in licences.TEMPLATES:
        best = max(2 * len(grams(u) & grams(t)) / (len(grams(u)) + len(grams(t))) for u in units(text or "") + windows(text or "", t))
        if best >= licences.THRESHOLD:
            out.append((round(-best, 9), name))
    return [(-d, n) for d, n in sorted(out)]


GRANT = licences.TEMPLATES[6][1]
APACHE = licences.TEMPLATES[1][1]
GPL = licences.TEMPLATES[12][1]
WRAPPED = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
TEXTS = [
    None, "", "Released under the MIT License.", "x\nLicensed under  the apache license, VERSION 2.0!\ny", "nothing to see here, move on",
    "This work is licensed under the GNU\nGeneral Public License, version 3.\n\nmore text", GRANT + "\n" + "and more " * 50, "a " * 4000,
    "Released under the MIT License. Released under the MIT License.", "Licensed under CC BY 4.0. " * 30, "\n\n".join([licences.TEMPLATES[11][1]] * 9), "no licence at all " * 20,
    "Copyright 2019 Foo Bar. Released under the MIT License. See LICENSE.",
    "#!/bin/sh\n#\n# Copyright 2020 A. B.\n#\n" + WRAPPED(GPL, "# ") + "\n#\n# It is hoped that this is of use.\nset -e\n",
    "/*\n * Copyright (c) 2011 C D\n" + WRAPPED(APACHE, " * ") + "\n */\nint main() { return 0; }\n", "import os\n// " + GRANT[:200] + "\n// " + GRANT[200:] + "\nx = 1",
    "é\r\nLicensed under CC BY-SA 4.0.\r\n\r\nü", "License license terms of the copyright. " * 40,
    "My tool (Released under the MIT License) is nice", "Foo 1.2, released under the MIT license, by Bar", "int x = 1 // Released under the MIT License.",
    "we say that this program is free software and that " + GPL + " so there, and " * 3 + "more of it without any end " * 200, "the MIT License the MIT License the MIT", "released under the",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = licences.scan_licences(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")).collect()
    return {r.doc_id: [(round(m.dice, 9), m.licence) for m in r.licence_matches] for r in rows}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_equals_brute_force(found, i):
    assert found[i] == brute(TEXTS[i])


def test_notices_are_met_wherever_they_stand(found):
    assert [n for _, n in found[12]] and found[12][0] == (1.0, "MIT")
    assert "GPL-3.0" in [n for _, n in found[13]] and "Apache-2.0" in [n for _, n in found[14]] and "MIT" in [n for _, n in found[15]]
    assert found[8] and found[9] and not found[17]
    assert [found[i][0] for i in (18, 19, 20)] == [(1.0, "MIT")] * 3 and (1.0, "GPL-3.0") in found[21] and not found[23]


def test_pruning_keeps_all_that_can_match():
    for n in range(2, 80):
        low, high = licences._bound(n, licences.THRESHOLD)
        for a in range(1, 200):
            if 2 * min(a, n) / (a + n) >= licences.THRESHOLD + 1e-9:
                assert low <= a <= high


def test_anchors_touch_what_a_match_needs():
    """Without the bigrams that an anchor touches no template reaches the threshold, whatever the unit."""
    anchors = set(licences.anchor_words())
    for _, text in licences.TEMPLATES:
        rest = {g for g in grams(text) if not anchors & set(g.split())}
        assert 2 * len(rest) / (len(rest) + len(grams(text))) < licences.THRESHOLD


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.execute(licences.op2_sql()).fetchall())
    assert sorted(tuple(r) for r in licences.op2_licence_scans(spark, d).collect()) == want


def test_sql_agrees_on_notices(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(licences.op2_sql()).fetchall())
    assert sorted(tuple(r) for r in licences.op2_licence_scans(spark, str(tmp_path)).collect()) == want


def test_edges(spark, edge_docs, no_docs):
    assert licences.scan_licences(edge_docs).count() == edge_docs.count() and licences.scan_licences(no_docs).count() == 0
    clash = edge_docs.withColumnsRenamed({"kept": "licence_matches", "score": "grams"})
    assert licences.scan_licences(clash).columns == ["doc_id", "text", "grams", "licence_matches"] or set(licences.scan_licences(clash).columns) == {"doc_id", "text", "grams", "licence_matches"}
