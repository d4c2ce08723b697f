from __future__ import annotations

import re

from lintel.llm import licenses
from lintel.llm.license_rules import BASE, signatures

from .conftest import odd_rows

UP = {i: i + 32 for i in range(65, 91)}
TEXTS = [r[1] for r in odd_rows()] + [
    "Released under the MIT License.", "mit  license MIT-license, the mit license; licensed under the Apache License, Version 2.0", "GNU\nGeneral (Public) License v3 and cc---BY 4.0", "cc by nc sa 4.0 cc by",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Éaccby cc éby ccby", "see http://www.gnu.org/licenses/gpl-3.0.html", "Copyright (c) 2019 2020 nobody. All rights reserved.", "permit license mit licenses", "KIT license MIT LICENSE " * 50,
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    hits = [(i, label) for phrase, label in BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.summary(licenses.scan(docs)).collect()}


def test_base_matches_plain_python(spark):
    got = scanned(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text and text[:60]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_labels(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "under the terms of the GNU Lesser General Public License v2.1", "no rights", "cc by nc sa 4.0"]
    got = scanned(spark, texts)
    assert [got[i]["labels"] for i in range(5)] == ["apache,apache-2.0", "gpl-2.0", "lgpl-2.1", "", "cc-by,cc-by-nc-sa"]


def test_rules_are_hundreds_and_compile():
    rules = signatures()
    assert len(rules) > 200 and all(re.compile(r.pattern) for r in rules)


def test_odd_and_empty(odd, empty):
    assert licenses.scan(odd).count() == odd.count()
    assert set(odd.columns) <= set(licenses.scan(odd).columns)
    assert licenses.summary(licenses.scan(empty)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "MIT License", 5, 6, 7)], "doc_id long, text string, license_words int, __license_low int, License_Found int")
    out = licenses.scan(docs)
    assert out.columns == ["doc_id", "text", "license_words_in", "__license_low_in", "License_Found_in", "license_words", "license_found", "license_hits"] or set(docs.columns) & set(out.columns) == {"doc_id", "text", "license_words"}
    row = out.first()
    assert (row["license_words"], row["license_words_in"], row["__license_low_in"], row["License_Found_in"]) == (2, 5, 6, 7)
    assert licenses.summary(out).first()["n_base"] == 1


def wholly(text, rules):
    """Labels and score of all rules, without gates: priority and containment by comparing all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    norm = " " + " ".join(words) + " " if words else " "
    hits = []
    for r in rules:
        for m in re.finditer(f" (?:{r.pattern})(?= )", norm):
            start = norm[: m.start()].count(" ")
            hits.append((start, start + m[0].count(" "), r.priority, r.order, r))
    kept = [h for h in hits if not any(g[:4] != h[:4] and g[2] >= h[2] and g[0] <= h[0] and g[1] >= h[1] and ((g[0], -g[1], -g[2], g[3]) < (h[0], -h[1], -h[2], h[3])) for g in hits)]
    labels = {h[4].label for h in kept} | {h[4].label for h in hits if h[4].base}
    return ",".join(sorted(labels)), max((h[4].weight for h in kept), default=0.0)


def test_labels_match_plain_python(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = [t for t in docs if t and re.search("(?i)licen|copyright|rights|spdx|domain", t)][:150] + TEXTS + ["licensed under the terms of the GNU Lesser General Public License v2.1 or the MIT License, see https://opensource.org/licenses/MIT", "All\nrights reserved. Copyright 2020 2021; public\ndomain"]
    got, rules = scanned(spark, texts), signatures()
    for i, text in enumerate(texts):
        assert (got[i]["labels"], got[i]["score"]) == wholly(text, rules), text and text[:80]
