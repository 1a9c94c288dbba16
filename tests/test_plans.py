"""Plan properties the design relies on, checked on the physical plans."""

import pytest

from conftest import SF_SMALL
from polyglint.plans.queries import QUERIES, _report_findings

WRITES = {"run_status", "run_counts", "write_review", "read_findings", "read_findings_files", "ingest_manual", "load_text_files", "segment_text_lines"}
FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_pairwise_join_or_python(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert not [f for f in FORBIDDEN if f in p]


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(QUERIES["review_texts_cells"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_texts_of_documents_are_not_shuffled(spark):
    for name in ("review_texts", "first_locations"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "hashpartitioning" not in p and "Sort" not in p, name


def some_pairs(spark):
    from pyspark.sql import functions as F
    n = F.col("id")
    return spark.range(400).select(
        F.lit("w").alias("workbook_id"), F.lit("s").alias("sheet"), F.concat(F.lit("A"), n).alias("coordinate"),
        F.concat(F.lit("\u4e2d"), n % 30).alias("source"), F.when(n % 11 != 0, F.concat(F.lit("t"), F.when(n % 30 < 9, n % 4).otherwise(0))).alias("target"),
        n.alias("pair_seq"))


def test_flat_texts_move_once(spark):
    from polyglint.operators.summary import review_texts
    segs = some_pairs(spark).selectExpr("pair_seq % 3 as doc_id", "pair_seq as seq", "coordinate as location", "source as text")
    final = executed(review_texts(segs)).split("== Initial Plan ==")[0]
    shuffles = [x for x in final.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 2 and all("_digest" in x for x in shuffles), final
    # the counts are of digests; the texts pass the limit first
    assert final.count("WindowGroupLimit") == 2 and "partial_count(1)" in final


def executed(df):
    df.collect()
    return plan(df)


def test_numbering_moves_rows_once(spark):
    from pyspark.sql import functions as F
    from polyglint.plans.strategy import number_rows
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = number_rows(df, ["a"], "n")
    final = executed(out).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(_range") - final.count("ReusedExchange") == 1, final
    assert "ReusedExchange" in final and "InMemory" not in final and "Scan ExistingRDD" not in final
    # the one step in a single task reads a count for each range
    single = final[final.index("SinglePartition"):].splitlines()[1]
    assert "text" not in single
    again = {r.a: r.n for r in number_rows(df.repartition(11), ["a"], "n").collect()}
    assert again == {r.a: r.n for r in out.collect()}


def test_consistency_reads_the_aggregate_once(spark):
    """Pairs are aggregated in one place (both readers of it share the shuffle),
    and only those of the filter's sources reach the window of coordinates."""
    from polyglint.operators import align as A
    pairs = some_pairs(spark)
    found = A.consistency_findings(pairs)
    assert found.count() == 9
    final = executed(found).split("== Initial Plan ==")[0]
    shuffles = [x for x in final.splitlines() if "Exchange hashpartitioning" in x and ", target#" in x.split("]")[0] and "Reused" not in x]
    assert len(shuffles) == 1, final
    assert "bitmap_construct_agg" in final


def test_scan_reads_only_needed_columns(spark):
    p = plan(QUERIES["segment_lines"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_segmenters_do_not_shuffle_by_document(spark):
    for name in ("segment_lines", "segment_markdown", "sensitive_findings", "segment_html"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "hashpartitioning(doc_id" not in p, name


def test_findings_have_no_single_partition(spark):
    assert "SinglePartition" not in plan(_report_findings(spark, SF_SMALL))


@pytest.mark.parametrize("name,tables", [
    ("segment_routed", 2), ("document_findings", 1), ("segment_totals", 1), ("segment_html", 1), ("segment_markdown", 1),
    ("review_texts", 1), ("first_locations", 1), ("segment_totals_sensitive", 1)])
def test_one_scan_for_each_table(spark, name, tables):
    from polyglint.session import _SCANS
    kept = dict(_SCANS)
    _SCANS.clear()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")     # a wide scan: nothing is spread and reused
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        p = plan(QUERIES[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        _SCANS.update(kept)
    assert p.count("FileScan") == tables, p
