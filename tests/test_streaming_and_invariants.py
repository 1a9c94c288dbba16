"""Streaming review, invariants over the bundled data, and partition
independence."""

import os

from pyspark.sql import functions as F

from polyglint.operators import align as A
from polyglint.operators import report as R
from polyglint.operators import summary as S
from polyglint.plans import fixtures as FX
from polyglint.plans import queries as Q
from polyglint.streaming.review_stream import start_review_stream, stream_findings

from conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    FX.fx_sensitive(spark, SF_SMALL).select("doc_id", "text", "lang",
                                            F.lit("s").alias("source"),
                                            F.length("text").cast("long").alias("n_chars")) \
        .repartition(3).write.parquet(src)
    q = start_review_stream(spark, src, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(tmp_dir, "out"))
    batch = stream_findings(spark.read.parquet(src))
    cols = ["doc_id", "location", "description"]
    assert streamed.count() == batch.count() > 0
    from polyglint.streaming.review_stream import observed_counts
    counts = observed_counts(q)
    assert counts["findings"] == batch.count() and counts["rejects"] == 0
    assert sum(v for k, v in counts.items() if k[0].isdigit()) == batch.count()
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0


def test_classes_partition_the_pairs(spark):
    pairs = Q._pairs(spark, SF_SMALL)
    stats = A.match_stats(pairs).filter(F.col("sheet").isNull())
    assert stats.agg(F.sum("n")).first()[0] == pairs.count() == 413


def test_review_texts_sum_to_segments(spark):
    from polyglint.sources.segmenters import line_segments
    segs = FX.fx_lines(spark, SF_SMALL)
    t = S.review_texts(segs)
    assert t.agg(F.sum("occurrence_count")).first()[0] == segs.count()
    # the flat form and the one inside the row give the same
    inside = S.document_texts(FX.documents(spark, SF_SMALL), line_segments("text"))
    assert inside.columns == t.columns
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, t.collect()))


def test_document_texts_of_odd_documents(spark):
    from polyglint.sources.segmenters import line_segments
    docs = spark.createDataFrame([(1, "b\u00e9 x\nzz\nb\u00e9 x\nzz\nzz\nzz"), (2, None), (3, ""), (4, "one"), (5, "aa\n" * 5000 + "bb")],
                                 "doc_id long, text string")
    got = {(r.doc_id, r.text): tuple(r)[2:] for r in S.document_texts(docs, line_segments("text")).collect()}
    assert got == {(1, "b\u00e9 x"): ("Line 1; Line 3", 2, 1), (1, "zz"): ("Line 2; Line 4; Line 5", 4, 2), (4, "one"): ("Line 1", 1, 1),
                   (5, "aa"): ("Line 1; Line 2; Line 3", 5000, 1), (5, "bb"): ("Line 5001", 1, 5001)}


def test_numbering_of_odd_keys(spark):
    """Nulls first, expressions in the order, quotes and line ends in keys, one range and many."""
    from polyglint.plans.strategy import number_rows
    keys = [None, "", "a\"b", "a\\n\n", "\u4e2d\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), "\x00z"]
    data = [(i % 977, keys[i % 6], -i) for i in range(3000)]
    df = spark.createDataFrame(data, "a long, s string, i long").repartition(5)
    want = sorted(data, key=lambda r: (r[1] is not None, (r[1] or "").encode(), -r[0], r[2]))
    for ranges in (1, 2, 64):
        out = number_rows(df, ["s", -F.col("a"), "i"], "n", ranges).orderBy("n").collect()
        assert [r.n for r in out] == list(range(1, 3001)) and [tuple(r)[:3] for r in out] == want
    assert number_rows(df.limit(0), ["s"], "n").count() == 0


def test_summary_total_equals_listed_findings(spark):
    f = Q._report_findings(spark, SF_SMALL)
    grand = R.report_summary(f, "all12").filter(F.col("dimension") == "总计").first()
    assert grand.total == f.count()
    core = R.report_summary(f, "core10").filter(F.col("dimension") == "总计").first()
    assert core.total == f.filter(~F.col("dimension").isin("增译", "漏译")).count()


def test_summary_out_of_metrics(spark):
    """Counts of one observed pass equal those of the aggregation."""
    f = Q._report_findings(spark, SF_SMALL)
    odd = f.limit(3).withColumn("severity", F.lit("P9")).unionByName(f.limit(2).withColumn("severity", F.lit(None).cast("string")))
    f = f.unionByName(odd)
    for dims in ("core10", "all12"):
        seen, obs = R.observed(f, f"m{dims}", R.report_metrics(dims))
        seen.write.format("noop").mode("overwrite").save()
        got = R.summary_of_metrics(spark, obs.get, dims)
        want = R.report_summary(f, dims)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert obs.get["rejects"] == R.report_rejects(f, dims).count() and obs.get["findings"] == f.count()


def test_result_independent_of_partitioning(spark):
    src, tgt = FX.fx_src(spark, SF_SMALL), FX.fx_tgt(spark, SF_SMALL)
    from polyglint.plans.review import review_bitext
    outs = []
    for n in (1, 64):
        r = review_bitext(src.repartition(n), tgt.repartition(n), persist=False)
        rows = r["findings"].select("location", "description", "severity").collect()
        outs.append(sorted(tuple(x) for x in rows))
    assert outs[0] == outs[1] and len(outs[0]) > 0


def test_review_texts_under_a_hot_text(spark):
    """One boilerplate line in every document: counts stay whole and the
    first locations are the first three in (doc, line) order."""
    docs = spark.range(0, 3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("All rights reserved.\nbody "), F.col("id").cast("string")).alias("text"))
    from polyglint.sources.segmenters import segment_lines
    segs = segment_lines(docs.repartition(12))
    t = {r.text: r for r in S.review_texts(segs, per_document=False).collect()}
    hot = t["All rights reserved."]
    assert hot.occurrence_count == 3000
    assert hot.locations == "0:Line 1; 1:Line 1; 2:Line 1"
    assert (hot.first_doc, hot.first_seq) == (0, 1)
    assert len(t) == 3001


def test_summary_stream(spark, tmp_dir):
    from polyglint.streaming.review_stream import start_summary_stream
    src = os.path.join(tmp_dir, "in")
    FX.fx_sensitive(spark, SF_SMALL).select("doc_id", "text", "lang",
                                            F.lit("s").alias("source"),
                                            F.length("text").cast("long").alias("n_chars")) \
        .repartition(2).write.parquet(src)
    q = start_summary_stream(spark, src, os.path.join(tmp_dir, "ck2"), "summary_t")
    q.awaitTermination(300)
    got = {(r.dimension, r.severity): r.n for r in spark.sql("SELECT * FROM summary_t").collect()}
    batch = stream_findings(spark.read.parquet(src)).groupBy("dimension", "severity").count()
    assert got == {(r.dimension, r.severity): r["count"] for r in batch.collect()}
    assert sum(got.values()) > 0


def test_numbering_with_a_hot_document(spark):
    from polyglint.plans.strategy import number_rows
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("doc_id"),
        F.col("id").alias("seq"))
    out = number_rows(df.repartition(7), ["doc_id", "seq"], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 20001))
    keys = [(r.doc_id, r.seq) for r in out]
    assert keys == sorted(keys)


def test_plan_texts_are_bounded(spark):
    """Texts of plans, which the driver keeps, grow no further with cached inputs."""
    from polyglint import session
    before = spark.conf.get(session.PLAN_TEXT)
    try:
        spark.conf.unset(session.PLAN_TEXT)
        f = Q._report_findings(spark, SF_SMALL)
        FX.fx_src(spark, SF_SMALL)
        for _ in range(4):
            f = f.unionByName(f)
        assert len(f._jdf.queryExecution().toString()) <= session.PLAN_TEXT_CHARS + 1000
        spark.conf.set(session.PLAN_TEXT, "5000")
        FX.fx_src(spark, SF_SMALL)
        assert spark.conf.get(session.PLAN_TEXT) == "5000"
    finally:
        spark.conf.set(session.PLAN_TEXT, before)
