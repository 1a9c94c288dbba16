"""The entry file with and without the corpus operators."""

import importlib.util

import __spark_entry__ as E


def test_entry_without_the_corpus_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec",
                        lambda name, *a: None if name in ("polyglint.llm", "corpus_pipeline") else find(name, *a))
    assert E._corpus_queries() == ({}, {})


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
