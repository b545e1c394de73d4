import brute
import pytest
from fleetlens.llm import licenses, queries
from nasty import documents, ordered, pairs

COLS = ("doc_id", "n_words", "n_base", "first_word", "last_word")


def test_base_equals_brute_force(spark):
    docs = documents(spark)
    got = licenses.scan(docs).collect()
    assert ordered((*[r[c] for c in COLS], ",".join(r["base_labels"])) for r in got) == ordered(brute.licenses(pairs(docs)))
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
    ("see https://creativecommons.org/licenses/by-sa/4.0/ ok", {"cc-by-sa-4.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ("The Mozilla Public License, v. 2.0 applies", {"mpl-2.0"}),
    ("Released under the Expat License.", {"mit"}), ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
    ("// spdx-license-identifier: (GPL-2.0-or-later WITH x-exception AND BSD-3-Clause) OR MIT.", {"gpl-2.0", "bsd-3-clause", "mit"}),
    ("SPDX-License-Identifier: unheard-of\nMIT License", {"mit"}), ("a mitigating license", set()), ("no word of it", set()), (None, set()),
])
def test_labels(spark, text, labels):
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert set(got["labels"]) == labels


def test_containment_keeps_the_better_or_longer_detection(spark):
    text = "Licensed under the GNU Lesser General Public License, version 2.1; MIT License"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    found = [(d["label"], text[d["start"]:d["end"]]) for d in got["found"]]
    assert found == [("lgpl-2.1", text[:text.index(";")]), ("mit", "MIT License")]


def test_many_matches_in_one_text(spark):
    text = "MIT License. Apache License 2.0, " * 3000
    got = licenses.scan(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")).collect()
    assert [(r["n_base"], r["labels"], len(r["found"])) for r in got] == [(6000, ["apache", "apache-2.0", "mit"], 6000)] * 2


def test_what_a_rule_finds_holds_a_keyword_of_it():
    """Every way through a pattern (its alternatives, options and repeats taken as they come) must pass the gate."""
    import re

    from hypothesis import HealthCheck, given, settings, strategies as st

    def gated(r, pattern):
        @settings(max_examples=25, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(pattern))
        def holds(text):
            m = pattern.search(text)
            assert set(re.split("[^a-z0-9]+", brute.lower(m[0]))) & set(r["keywords"]), (r["label"], m[0])

        holds()

    for r in licenses.rules():
        gated(r, re.compile(r["pattern"].replace("*+", "*").replace("++", "+"), re.A))


def test_there_are_hundreds_of_rules():
    assert len(licenses.rules()) > 300


def test_registered_query(spark, sf):
    got = queries.op5_licenses(spark, sf.dir).collect()
    assert ordered(tuple(r)[:6] for r in got) == ordered(brute.licenses(sf("documents", "doc_id", "text")))
