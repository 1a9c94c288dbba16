"""The pipeline against plain versions of its stages, one after the other."""

import hashlib

import duckdb
import pandas as pd
import pyarrow as pa

import corpus_pipeline
from fixtures import DOCS, SF, docs, given, with_extra
from polyglint.llm import langid, mixing
from test_op3_sanitize import expected as disclosed
from test_op3_sanitize import plain
from test_op8_simhash import brute as near_groups
from test_op9_op10_tokens import ids_of

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text, spans):
    cuts = []
    for kind, s, e in (x.split(":") for x in spans.split(",") if x):
        s, e = int(s), int(e)
        word = text[s:e]
        tag = {"removed": "", "generalised": "[NUMBER]" if word.isdigit() else "[NAME]" if word[0].isupper() else "[WORD]"}
        cuts.append((s, e, tag.get(kind, f"[{kind.upper()}]")))
    out, at = "", 0
    for s, e, tag in sorted(cuts):
        out += text[at:s] + tag if s >= at else ""
        at = max(at, e)
    return out + text[at:]


def plain_run(spark, rows):
    """All stages in Python over rows (COLS) without repeated ids."""
    model = langid.fit(spark.createDataFrame([r for r in rows if not held(r[0])], DOCS))
    langs, _ = model.predict([r[1] or "" for r in rows])
    rows = [r for r, lang in zip(rows, langs) if lang != "und"]
    groups = {i: c for i, _, c in near_groups([r[:2] for r in rows])}
    rows = [r for r in rows if groups[r[0]] == r[0]]
    spans = {x[0]: x[-1] for x in disclosed(rows)}
    clean = []
    for r in rows:
        t = r[1] if not spans[r[0]] else masked(r[1], spans[r[0]])
        clean.append((r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)))
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(pd.DataFrame(clean, columns=COLS), preserve_index=False))
    taken = con.execute(f"SELECT doc_id FROM ({mixing.oracle()})").fetchall()
    by_id = {r[0]: r for r in clean}
    out = []
    for (i,) in taken:
        _, t, lang, source, n = by_id[i]
        ids = ids_of(t)
        out.append((i, lang, source, n, len(ids), hashlib.sha256(ids.tobytes()).hexdigest()))
    return out


def held(doc_id):
    import zlib
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_run_matches_plain_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256"]
    rows = got.collect()
    want = plain_run(spark, [tuple(r) for r in given(spark).select(COLS).collect()])
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.lang, r.source, r.n_chars, r.n_tokens, r.ids_sha256)) for r in rows)
    assert all(len(r.ids) == r.n_tokens and ids_of_bytes(r.ids) == r.ids_sha256 for r in rows)


def ids_of_bytes(ids):
    import numpy as np
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark):
    """Each stage on awkward rows, with clashing columns, and on no rows."""
    df = with_extra(docs(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
        assert out.count() > 0, name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, df, SF).count() == df.count() and last(spark, df.limit(0), SF).count() == 0


def test_there_are_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "PII", "mixing sources to target weights", "BPE encoding and decoding"]


def test_texts_go_to_the_workers_in_small_batches(spark):
    """10,000 whole texts a batch stand outside of the heap, twice in each task."""
    from polyglint.llm import common

    def rows(it):
        for b in it:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get(common.BATCH_ROWS)
    try:
        for given, most in (("10000", common.TEXT_ROWS), ("300", 300)):
            spark.conf.set(common.BATCH_ROWS, given)
            n = [r.n for r in common.map_arrow(spark.range(0, 5000, 1, 1), rows, "n long").collect()]
            assert sum(n) == 5000 and max(n) == most
    finally:
        spark.conf.set(common.BATCH_ROWS, before)
