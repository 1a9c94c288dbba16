"""The job functions end to end on the smallest bundled scale factor."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from polyglint.plans import fixtures as FX
from polyglint.plans import review as RV


def test_review_documents_and_findings_only(spark):
    docs = FX.fx_sensitive(spark, SF_SMALL).select("doc_id", "text")
    r = RV.review_documents(docs, fmt="txt")
    n_find = r["findings"].count()
    assert n_find > 0
    assert r["totals"].agg(F.sum("automated_count")).first()[0] == n_find
    assert r["review_texts"].agg(F.sum("occurrence_count")).first()[0] == r["segments"].count()
    only = RV.review_documents(docs, fmt="txt", findings_only=True)
    assert set(only) == {"findings"} and only["findings"].count() == n_find
    src = RV.review_documents(docs, fmt="txt", is_source=True)
    assert src["findings"].count() == 0


def test_compare_documents(spark):
    docs = FX.fx_sensitive(spark, SF_SMALL).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    roles = FX.doc_roles(FX.documents(spark, SF_SMALL).select("doc_id"))
    r = RV.compare_documents(docs, roles)
    cmp = {row.pair_id: row for row in r["compare"].collect()}
    assert len(cmp) == 101
    assert all(row.source_ok and row.target_ok for k, row in cmp.items() if k >= 0)
    assert (cmp[-1].target_ok, cmp[-1].target_count, cmp[-1].target_format) == (False, 0, "unknown")
    assert {row.source_format for row in cmp.values()} == {"txt"}
    assert r["sections"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 200
    found = r["findings"].count()
    assert found > 0 and sum(row.automated_count for row in cmp.values()) == found
    every = RV.compare_documents(docs, roles, cap=None)["sections"]
    assert every.count() == RV.review_corpus(docs)["segments"].count()


def test_review_corpus_sources_and_office_files(spark):
    docs = spark.createDataFrame(
        [(1, "/a.md", "```\nonly code", False), (2, "/b.txt", "illegal 中文", True), (3, "/c.txt", "illegal 中文", False),
         (4, "/d.docx", "", False), (5, "/e.html", "<li><div>nested 中文 kill</div></li>", None)],
        "doc_id long, path string, text string, is_source boolean")
    r = RV.review_corpus(docs)
    assert {f.doc_id for f in r["findings"].collect()} == {"3", "5"}
    totals = {t.doc_id: (t.total_sections, t.automated_count) for t in r["totals"].collect()}
    assert totals[1] == (0, 0) and totals[2] == (1, 0) and totals[4] == (0, 0) and totals[3][1] == 2
    assert sum(n for _, n in totals.values()) == r["findings"].count()
    assert [u.parser for u in r["unsegmented"].collect()] == ["docx"]


def test_scan_workbook(spark):
    r = RV.scan_workbook(FX.fx_conv_cells(spark, SF_SMALL))
    sheets = {row.sheet: row for row in r["sheets"].collect()}
    assert set(sheets) == {"assistant", "system", "user"}
    assert sum(row.total_cells for row in sheets.values()) == r["cells"].count()
    wb = r["workbook"].first()
    assert (wb.sheet_count, wb.sheet_names) == (3, "assistant, system, user")
    assert r["samples"].groupBy("sheet", "lang").count().agg(F.max("count")).first()[0] <= 25


def test_review_bitext_and_build_report(spark):
    r = RV.review_bitext(FX.fx_src(spark, SF_SMALL), FX.fx_tgt(spark, SF_SMALL))
    assert r["pairs"].count() == 413
    tot = r["totals"].first()
    assert (tot.total_pairs, tot.total_findings) == (413, r["findings"].count())
    ct = r["consistency_totals"].first()
    assert (ct.total_unique, ct.issues) == (61, 17)
    rep = RV.build_report(r["findings"], dims="all12")
    assert rep["detail"].count() == r["findings"].count()
    grand = rep["summary"].filter(F.col("dimension") == "总计").first()
    assert grand.total == r["findings"].count()
    assert rep["rejects"].count() == 0
