"""Small tables with the awkward rows that every corpus operator must take."""

import os
import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators make themselves, here with other meanings
EXTRA = ["score", "fp", "component_id", "range", "term", "epoch", "ids", "node", "text_hash", "n_tokens"]

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "a", "Hello, World! it's 12.5 MB", "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine ten", "é è ñ。你好 世界 ü", "x" * 5000, "\n\n  odd \t spacing\r\n here ",
    "😀 😀 emoji 😀\n", "<|endoftext|> is <|endoftext|>text", "12 345 678", "....!!! ?", LONG, LONG + " end",
    "Zażółć gęślą jaźń", "the quick brown fox jumps over the lazy dog " * 40,
]


def rows(seed=7, n=60):
    """The awkward texts, repeated ids and nulls in every column, and random prose."""
    rnd = random.Random(seed)
    out = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(TEXTS)]
    words = ["tion", "the", "and", "of", "haus", "der", "est", "que", "el", "los", "and.", "in,", "Of", "x@y.z"]
    for i in range(n):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200)))
        out.append((100 + i, t, rnd.choice(["en", "de"]), "a" if i % 3 else "c", len(t)))
    out += [(3, "same id, other text", "en", "a", None), (5, TEXTS[5], "en", "b", 1), (None, "no id here", "en", "a", 3),
            (None, None, None, None, None), (-4, "negative id", "en", "a", 2)]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS).repartition(3)


def with_extra(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


def given(spark, table="documents"):
    return spark.read.parquet(os.path.join(SF, f"{table}.parquet"))


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def same(a, b):
    assert sorted(map(tuple, a), key=lambda r: repr(r)) == sorted(map(tuple, b), key=lambda r: repr(r))


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
