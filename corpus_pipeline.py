"""Corpus preparation as one pipeline over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyglint.llm import bpe_reuse, langid, mixing, sanitize, simhash
from polyglint.llm.common import read, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay; those without a letter go (a null
    or empty text has none; where no label is known, all go).  Rows that repeat
    are judged alike; an empty table stays empty."""
    return langid.accepted(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.  Null and empty texts are
    copies of one another; rows that share an id but not a text both stay; a row
    without an id stays where its group has no other."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and what discloses it is replaced in their
    texts.  A null text stays null, rows that repeat are treated alike."""
    return sanitize.sanitise(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target weights of their sources ask for.  A null source
    is a source; rows that repeat are documents of their own; an empty table
    stays empty."""
    return mixing.mixed(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids, ids_sha256) of every row; a
    null or empty text has no ids."""
    return bpe_reuse.encode(docs).select(
        "doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixture),
    ("BPE encoding and decoding", bpe_ids),
]

# A fitted classifier, contracted graphs and a tokenizer's merges are not said
# in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
