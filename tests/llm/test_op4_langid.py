import zlib

import numpy as np
from fixtures import DOCS, SF, docs, given, with_extra
from polyglint.llm import langid
from polyglint.llm.queries import QUERIES


def slow_scores(model, text):
    """One n-gram after the other."""
    c = [ch if ch.isalpha() else " " for ch in " " + text.lower() + " "]
    total, seen = model.prior.copy(), 0
    for k, n in enumerate(langid.ORDERS):
        for i in range(len(c) - n + 1):
            gram = c[i:i + n]
            if any(x != " " for x in gram):
                h = 0
                for x in gram:
                    h = (h * 0x100000001B3 & (1 << 64) - 1) ^ ord(x)
                h = (h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - langid.BITS)
                total += model.log_prob[h + (k << langid.BITS)]
                seen += 1
    return total, seen


def test_batch_scores_are_those_of_single_ngrams(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 64)     # long texts run over many pieces
    model = langid.fit(given(spark))
    texts = ["", "a", "Hello world, this is it. " * 30, "é " * 100, "123 !!", " x", "abc" * 70]
    total, seen = model.scores(texts)
    for t, row, n in zip(texts, total, seen):
        want, m = slow_scores(model, t)
        np.testing.assert_allclose(row, want, rtol=1e-9)
        assert n == m


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in given(spark).collect()}
    rows = QUERIES["op4_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_from_text_and_label_alone(spark):
    """Held-out labels, sources and other columns change nothing."""
    df = given(spark)
    odd = df.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) as lang", "'s' as source",
                        "n_chars")
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd).collect()}


def test_awkward_rows(spark):
    df = docs(spark)
    got = langid.identify(with_extra(df)).collect()
    assert len(got) == df.count()
    blank = [r for r in langid.predict(df, langid.fit(df)).collect() if not any(c.isalpha() for c in r.text or "")]
    assert blank and all(r.lang_pred == "und" and r.score == 0 for r in blank)
    assert all(r.held_out is False for r in got if r.doc_id is None)
    kept = langid.accepted(with_extra(df))
    assert kept.columns == with_extra(df).columns
    assert all(any(c.isalpha() for c in r.text or "") for r in kept.collect())
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None, "a", 4)], DOCS)
    assert [tuple(r) for r in langid.identify(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_every_label_is_learned_with_its_own_share(spark):
    """The prior is that of all labelled rows, whatever the sample; none is dropped."""
    import pytest
    data = [(i, "der die das und haus" if i % 10 else "the and of house", "de" if i % 10 else "en", "a", 1) for i in range(1000)]
    data += [(2000 + i, f"wort{i} xq", f"l{i:03d}", "a", 1) for i in range(300)]
    df = spark.createDataFrame(data, DOCS)
    model = langid.fit(df, docs_per_language=50)
    assert len(model.languages) == 302
    assert np.exp(model.prior[model.languages.index("de")]) == pytest.approx(900 / 1300)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(df, max_languages=301)


def test_low_probabilities_are_no_reason_to_reject(spark):
    data = [(i, t, lang, "a", 1) for i, (t, lang) in enumerate([("der", "de"), ("the", "en"), ("que", "es"), ("les", "fr")] * 8)] + [(99, "x", None, "a", 1)]
    df = spark.createDataFrame(data, DOCS)
    assert langid.accepted(df).count() == len(data)


def test_fitted_counts_match_plain_ones(spark):
    """Counts of hashed n-grams a language, from plain loops over the pieces."""
    data = [(1, "ab", "x", "s", 1), (2, "ba b", "x", "s", 1), (3, "zz", "y", "s", 1)]
    model = langid.fit(spark.createDataFrame(data, DOCS))
    width = len(langid.ORDERS) << langid.BITS
    want = np.zeros((2, width))
    for _, text, lang, _, _ in data:
        for piece in langid._pieces([text]):
            for bucket, _ in langid._buckets(*piece):
                for b in bucket.tolist():
                    want["xy".index(lang), b] += 1
    want += langid.SMOOTHING
    by_order = want.reshape(2, len(langid.ORDERS), -1)
    assert np.allclose(model.log_prob.T, np.log(by_order / by_order.sum(axis=2, keepdims=True)).reshape(2, width))
