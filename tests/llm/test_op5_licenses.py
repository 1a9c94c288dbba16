import re

import pytest
from fixtures import SF, docs, given, same, with_extra
from polyglint.llm import licenses
from polyglint.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def brute(doc_id, text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


NOTICES = [
    "Released under the MIT License. Under the mit license, under  the-MIT\nlicense!", "CC BY-NC 4.0 and cc by nc cc by nc",
    "Apache License, Version 2.0", "apache license version 20", "under the mit licenses", "xunder the mit license",
    "SPDX-License-Identifier: MIT OR Apache-2.0", "# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND MIT\nx",
    "spdx-license-identifier:", "SPDX-License-Identifier: MIT and then prose", "émit under the mit license é",
]


def test_base_places(spark):
    data = [(i, t, "en", "a", 0) for i, t in enumerate(NOTICES)]
    got = licenses.scan(docs(spark, data))
    same(got.select(COLS).collect(), [brute(r[0], r[1]) for r in data])
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert labels[6] == "apache-2,mit" and "gpl-2" in labels[7] and "mit" in labels[7] and labels[8] == ""
    assert labels[9] == "mit" and labels[5] == ""
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_query_and_awkward_rows(spark):
    same(QUERIES["op5_license_scan"](spark, SF).select(COLS).collect(), [brute(r.doc_id, r.text) for r in given(spark).collect()])
    df = docs(spark)
    same(licenses.scan(with_extra(df)).select(COLS).collect(), [brute(r.doc_id, r.text) for r in df.collect()])
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,postfix", [
    ("mit", "mit"), ("mit or bsd and gpl-2.0", "mit bsd gpl-2.0 and or"), ("(mit or bsd) and gpl-2.0", "mit bsd or gpl-2.0 and"),
    ("a-1 with x-1 or b-1", "a-1 x-1 with b-1 or"), ("a-1 and b-1 or c-1", "a-1 b-1 and c-1 or"), ("a-1 or", "a-1"),
    ("or a-1", ""), ("(a-1 or b-1", ""), ("a-1) or b-1", "a-1"), ("a-1 b-1", "a-1"), ("", ""), ("((a-1))", "a-1"),
    ("a-1 and (b-1", "a-1"), ("a-1 () b-1", "a-1"), ("mit and then some", "mit"), ("mit.", "mit"), ("prose", ""), ("-", ""),
])
def test_shunting_yard(text, postfix):
    assert " ".join(licenses.to_postfix(text)) == postfix


def test_evaluation():
    free = lambda t: licenses.evaluate(licenses.to_postfix(t))[1]
    assert free("mit and gpl-2.0") == 0.3 and free("mit or gpl-2.0") == 1.0
    assert free("gpl-2.0 with classpath-exception-2.0") == 0.5 and free("") == 0.0


@pytest.mark.parametrize("said,labels", [
    ("ISC", "isc"), ("Zlib", "zlib"), ("curl", "curl"), ("PostgreSQL", "postgresql"), ("WTFPL\nx", "wtfpl"), ("MIT AND ISC", "isc,mit"),
    ("(MIT OR ISC)", "isc,mit"), ("(MIT OR Acme) AND BSD", "acme,bsd,mit"), ("(mit or acme)", "acme,mit"), ("Acme", "acme"),
    ("MIT OR Acme", "acme,mit"), ("MIT and Then prose", "mit"), ("MIT or any later", "mit"), ("MIT and (See the file)", "mit"),
    ("NOASSERTION", ""), ("see the file", ""), ("See LICENSE file", ""), ("isc and other things", "isc"),
])
def test_names_without_digit_or_hyphen(said, labels):
    got = licenses.scan_text(f"é # SPDX-License-Identifier: {said}")
    assert ",".join(sorted(got["labels"])) == labels


def test_time_grows_with_the_text_and_not_with_its_square():
    import time

    def seconds(n):
        text = "cc by nc " * n + "spdx-license-identifier: MIT " * (n // 10)
        t = time.process_time()
        r = licenses.scan_text(text)
        assert len(r["places"]) == n and len(r["expressions"]) == n // 10
        assert [p[0] for p in r["places"]] == [3 * k for k in range(n)]
        return time.process_time() - t

    seconds(2000)
    assert seconds(80_000) < 12 * seconds(10_000) + 0.5
