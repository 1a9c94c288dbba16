import hashlib
import random

import numpy as np
import pytest
from fixtures import DOCS, SF, docs, given, same, with_extra
from polyglint.llm import suffix_dedup
from polyglint.llm.queries import QUERIES

W = suffix_dedup.WINDOW


def brute(rows):
    """Every window of the corpus, one after the other."""
    import xxhash
    tie = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() & (1 << 23) - 1
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1] or "")))
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - W + 1):
            w = raw[s:s + W]
            if w in seen:
                gone[s:s + W] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    """Copies, near copies, shared passages and lines, periodic runs."""
    rnd = random.Random(seed)
    prose = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(n))
    shared, line, long = [prose(40) for _ in range(3)], prose(13), prose(600)
    out = [prose(60) + rnd.choice(shared) + prose(rnd.randint(0, 30)) for _ in range(12)]
    out += [f"{prose(20)}\n{line}\n{prose(20)}" for _ in range(12)]
    out += ["x" * 450, "x" * 99, "x" * 100, "x" * 101, "ab" * 200, prose(3) + "ab" * 80, out[0], out[0], out[1][:150], ""]
    for _ in range(8):
        w = long.split(" ")
        for _ in range(rnd.randint(1, 12)):
            w[rnd.randrange(len(w))] = prose(1)
        out.append(" ".join(w))
    rnd.shuffle(out)
    return [(3 * k % 101, t, "en", "a", 0) for k, t in enumerate(out)]


@pytest.mark.parametrize("piece,block,many", [(1 << 19, 1 << 20, 256), (300, 40, 1), (150, 1, 3)])
def test_matches_brute_force(spark, piece, block, many):
    data = passages(piece)
    got = suffix_dedup.deduplicate(docs(spark, data), phrases_per_trigger=many, piece=piece,
                                   block=block, keep_text=True).collect()
    same([tuple(r)[:5] for r in got], brute([r[:2] for r in data]))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_resolution_across_batches(spark):
    """A trigger's rows run over many record batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = passages(5)
        same(suffix_dedup.deduplicate(docs(spark, data), phrases_per_trigger=2).collect(), brute([r[:2] for r in data]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows_and_query(spark):
    df = docs(spark).where("doc_id is null or doc_id not in (14, 15)")
    same(suffix_dedup.deduplicate(with_extra(df)).collect(), brute([(r.doc_id, r.text) for r in df.collect()]))
    same(QUERIES["op7_suffix_dedup"](spark, SF).collect(), brute([(r.doc_id, r.text) for r in given(spark).collect()]))
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    t = "some words that go on for quite a while " * 5
    data = [(1, t, "en", "a", 0), (1, t, "en", "a", 0), (1, t + "!", "en", "a", 0), (None, t, "en", "b", 0), (2, "short", "en", "a", 0),
            (2, "short", "en", "a", 0)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(data, DOCS)).collect()
    same(got, brute([r[:2] for r in data]))


def test_phrases_cover_each_window_once():
    rnd = np.random.default_rng(1)
    for n in (99, 100, 101, 1000, 20_000):
        b = rnd.integers(97, 100, n).astype(np.uint8)
        _, _, start, size = suffix_dedup.parse(b)
        windows = np.concatenate([np.arange(s, s + k - W + 1) for s, k in zip(start, size)] or [np.empty(0)])
        assert windows.tolist() == list(range(max(0, n - W + 1)))
        assert not len(size) or size.max() <= 2 * W - suffix_dedup.GRAM
