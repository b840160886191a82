import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quadloom.llm import licenses as L
from quadloom.llm.license_rules import HEADING, SIGNATURES, gates, rules

TEXTS = [
    None, "", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
    "Licensed under CC BY-NC 4.0.", "cc by cc by, CC-BY", "general public\nlicense", "É all  rights\treserved all rights reserved", "SPDX-License-Identifier: Apache-2.0", "mit der Lizenz", "GPL GENERAL PUBLIC LICENSE general",
    "word " * 50_000 + "all rights reserved", "\x00cc\x01by\x7f", "Apache License\nApache License, Version 2.0", "licensed under the BSD 3-Clause License",
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in L.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


@pytest.fixture(scope="module")
def found(spark):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumns({"labels": F.lit("old"), "score": F.lit(9), "__x": F.lit(1)})
    return L.scan_licenses(frame).collect()


def test_base_equals_brute_force(found):
    assert len(found) == len(TEXTS) + 1
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


@pytest.mark.parametrize(("i", "labels"), [(1, ""), (2, "apache-2.0"), (3, "mit"), (4, "gpl,gpl-3.0"), (5, "all-rights-reserved,reserved"), (6, "cc-by,cc-by-nc-4.0"), (10, "apache-2.0"), (11, ""), (15, "apache,apache-2.0"), (16, "bsd-3-clause")])
def test_labels(found, i, labels):
    assert next(r.labels for r in found if r.doc_id == i) == labels


def brute_labels(text):
    """All rules at every word of the whole text; a heading's words stand in one line. Intervals inside better ones go."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words, ends = [], []
    for line in low.split("\n"):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line)
        words += found
        ends += [False] * (len(found) - 1) + [True] * bool(found)
    s = " " + "".join(f"{w} " for w in words)
    t = " " + "".join(w + ("\n" if end else " ") for w, end in zip(words, ends, strict=True))[:-1] + " "
    hits = []
    for i, x in enumerate(rules()):
        heading = x.pattern.startswith(HEADING)
        pattern = re.compile((HEADING + x.pattern.removeprefix(HEADING).replace(" ", "[ \n]") if heading else x.pattern) + "(?=[ \n])")
        at = 0
        while (at := at + 1) < len(s):
            if s[at - 1] == " " and (m := pattern.match(t if heading else s, at)):
                hits.append((at, m.end(), x.priority, i, x))
    beats = lambda g, h: g[0] <= h[0] and g[1] >= h[1] and (g[2], g[1] - g[0], -g[3]) > (h[2], h[1] - h[0], -h[3])
    kept = [h for h in hits if not any(beats(g, h) for g in hits)]
    return {h[4].label for h in kept}, max([0.0, *(h[4].weight for h in kept)])


def test_suppression_equals_brute_force(spark, found):
    for r in found:
        if len(TEXTS[r.doc_id] or "") < 10_000:
            labels, best = brute_labels(TEXTS[r.doc_id])
            assert set(r.labels.split(",")) - {""} == labels | (set(r.base_labels.split(",")) - {""}), TEXTS[r.doc_id]
            assert r.score == max(best, L.BASE_WEIGHT if r.n_base else 0.0)


def test_windows_equal_brute_force(spark, monkeypatch):
    """Matches at the edges of windows, and more of them than a window holds."""
    monkeypatch.setattr(L, "WINDOW", 7)
    rng, parts = random.Random(3), ["licensed under the", "mit license", "apache license version 2 0", "cc by", "word", "all rights reserved", "license\n", "the gnu general public\nlicense version 3", "creative commons", "permission is hereby granted free of charge"]
    texts = ["\n".join(" ".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(4)) for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan_licenses(frame).collect():
        labels, best = brute_labels(texts[r.doc_id])
        assert set(r.labels.split(",")) - {""} == labels | (set(r.base_labels.split(",")) - {""}), texts[r.doc_id]


def test_every_rule_holds_a_gate():
    """Each signature's own text passes the gates and is found by its rule."""
    for r in rules():
        assert re.compile(r.pattern)
    for line in SIGNATURES.strip().splitlines():
        keyword, pattern, *_ = line.split(" | ")
        for one in pattern.split("|") if "(" not in pattern else []:
            text = re.sub(r"\.\{\d+,\d+\}\??", "some name", re.sub(r"\[([^\]])[^\]]*\]", r"\1", one)).replace(" ?", " ").replace("e?", "e")
            assert keyword in f" {text} " and any(g in f" {text} " for g in gates()), line


def test_work_grows_with_the_text(spark):
    """A quarter of a megabyte of matches in one line."""
    text = "licensed under the mit license " * 8000
    start = time.time()
    r = L.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "mit" and time.time() - start < 60


def test_plan_is_native(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = L.scan_licenses(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert len(rules()) > 300
    assert L.scan_licenses(frame.limit(0)).collect() == []


WRAPPED = [
    ("Licensed under the Apache License,\nVersion 2.0", {"apache-2.0"}),
    ("the terms of the GNU General\nPublic License, version 3", {"gpl-3.0", "gpl"}),
    ("# Permission is hereby granted, free\n# of charge", {"mit-text"}),
    ("This is Public-Domain now", {"public-domain"}),
    ("in the public  domain", {"public-domain"}),
    ("MIT\nlicense and\nthe\nBSD 3-\nClause License", {"mit", "bsd-3-clause"}),
    ("word " * 20_000 + "released under\nthe MIT License. " * 300, {"mit"}),
]


def test_signatures_run_over_lines(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRAPPED)], "doc_id long, text string")
    for r in L.scan_licenses(frame).collect():
        assert set(r.labels.split(",")) == WRAPPED[r.doc_id][1], WRAPPED[r.doc_id][0][-60:]
