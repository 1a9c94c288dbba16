"""Report: defaults, summary, numbering, readers and sinks."""

import json
import os

from pyspark.sql import functions as F

from polyglint.operators import report as R

FIND = "dimension string, severity string, location string, description string"


def findings(spark, rows):
    return spark.createDataFrame(rows, FIND)


def test_summary_keeps_zero_rows_and_totals(spark):
    f = findings(spark, [("漏翻", "P1", "a", "x"), ("漏翻", None, "b", "y"), ("增译", "P2", "c", "z"),
                         ("敏感词", "P0", "d", "w"), ("unknown", "P1", "e", "v")])
    core = {r.dimension: r for r in R.report_summary(f, "core10").collect()}
    assert len(core) == 11
    assert (core["漏翻"].P1, core["漏翻"].P3, core["漏翻"].total) == (1, 1, 2)
    assert core["错译"].total == 0
    assert "增译" not in core
    assert (core["总计"].P0, core["总计"].total) == (1, 3)
    all12 = {r.dimension: r for r in R.report_summary(f, "all12").collect()}
    assert all12["增译"].P2 == 1 and all12["总计"].total == 4


def test_invalid_severity_goes_to_rejects(spark):
    f = findings(spark, [("漏翻", "P9", "a", "x"), ("漏翻", "P1", "b", "y")])
    assert R.report_rejects(f).count() == 1
    s = {r.dimension: r.total for r in R.report_summary(f).collect()}
    assert s["漏翻"] == 1


def test_detail_numbering_is_dense_and_ordered(spark):
    rows = [(str(i % 7), "d", "P1", f"L{i}", "x", 0, i, 0) for i in range(500)]
    f = spark.createDataFrame(rows, "doc_id string, dimension string, severity string, "
                                    "location string, description string, phase long, seq long, "
                                    "sub long")
    d = R.report_detail(f.repartition(13)).orderBy("n").collect()
    assert [r.n for r in d] == list(range(1, 501))
    expect = sorted(rows, key=lambda r: (r[0], r[5], r[6], r[7]))
    assert [r.location for r in d] == [e[3] for e in expect]
    assert d[0].fill_rgb == "FF9933"


def test_merge_assessment_markdown(spark):
    a = findings(spark, [("漏翻", "P1", "a", "x")])
    b = findings(spark, [("地道性", None, "b", "y")])
    m = R.merge_findings(a, b)
    assert sorted(r.stream for r in m.collect()) == [0, 1]
    s = R.report_assessment(R.report_summary(m), "Overall fine.")
    assert s.filter(F.col("dimension") == "assessment").first().note == "Overall fine."
    md = R.markdown_summary(R.report_summary(m)).orderBy("dim_ord").collect()
    assert md[0].line == "| 维度 | P0 | P1 | P2 | P3 | 合计 |"
    assert md[2].line == "| 漏翻 | 0 | 1 | 0 | 0 | 1 |"


def test_read_findings_list_and_object(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.json"), "w", encoding="utf-8") as fh:
        json.dump([{"dimension": "漏翻", "severity": "P1", "location": "L1", "description": "d"},
                   {"dimension": "错译", "location": "L2", "description": "e"}], fh,
                  ensure_ascii=False)
    with open(os.path.join(tmp_dir, "b.json"), "w", encoding="utf-8") as fh:
        json.dump({"findings": [{"dimension": "一致性", "severity": "P2", "location": "L3",
                                 "description": "f"}], "assessment": "ok"}, fh, ensure_ascii=False)
    found, assess = R.read_findings(spark, tmp_dir)
    got = sorted((r.dimension, r.severity) for r in found.collect())
    assert got == [("一致性", "P2"), ("漏翻", "P1"), ("错译", None)]
    assert [r.assessment for r in assess.collect()] == ["ok"]


def test_read_findings_keys_empty_and_broken_files(spark, tmp_dir):
    files = {
        "a.json": json.dumps({"automated_findings": [{"dimension": "漏翻", "location": "A"}], "findings": [
            {"dimension": "一致性", "location": "F"}]}),
        "b.json": "{}", "c.json": "not json at all", "d.json": "[]",
        "e.json": json.dumps([{"dimension": "x", "location": f"E{i}"} for i in range(12)]),
        "f.jsonl": "",
    }
    for name, text in files.items():
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    found, _ = R.read_findings(spark, tmp_dir)
    assert sorted(r.location for r in found.collect()) == sorted(["F", *[f"E{i}" for i in range(12)]])
    auto, _ = R.read_findings(spark, tmp_dir, findings_key="automated_findings")
    assert "A" in {r.location for r in auto.collect()} and "F" not in {r.location for r in auto.collect()}
    rejects = R.read_rejects(spark, tmp_dir).collect()
    assert [r.record for r in rejects] == ["not json at all"] and rejects[0].file.endswith("c.json")
    # numbered in the order of files and places, the same in every run
    for _ in range(2):
        detail = sorted((r.n, r.location) for r in R.report_detail(found).collect())
        assert [x for _, x in detail] == ["F", *[f"E{i}" for i in range(12)]]


def test_read_findings_counts_as_they_stand(spark, tmp_dir):
    """{} and objects of unknown keys in a list are findings; an object without
    findings has none; what is no JSON, no container or no object is a reject."""
    files = {
        "a.json": '[{}, {"x": 1}, {"severity": "P0", "location": 7}, {"severity": null}, 5, "s", [1]]',
        "b.json": '{"findings": [{}], "assessment": "fine"}', "c.json": "{}", "d.json": '{"dimension": "d"}',
        "e.json": '{"findings": {"severity": "P1"}}', "f.json": "[{]", "g.json": "17", "h.json": "  \n", "i.json": '{"findings": []}',
    }
    for name, text in files.items():
        with open(os.path.join(tmp_dir, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    found, assess = R.read_findings(spark, tmp_dir)
    counts = {os.path.basename(r.file): r["count"] for r in found.groupBy("file").count().collect()}
    assert counts == {"a.json": 4, "b.json": 1}
    assert [r.assessment for r in assess.collect()] == ["fine"]
    detail = R.report_detail(found).orderBy("n").collect()
    assert [(r.severity, r.location, r.dimension) for r in detail] == [
        ("P3", "", ""), ("P3", "", ""), ("P0", "7", ""), ("P3", "", ""), ("P3", "", "")]
    rejects = sorted((os.path.basename(r.file), r.record) for r in R.read_rejects(spark, tmp_dir).collect())
    assert rejects == [("a.json", '"s"'), ("a.json", "5"), ("a.json", "[1]"), ("e.json", files["e.json"]), ("f.json", "[{]"), ("g.json", "17")]


def test_read_findings_lines(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.jsonl"), "w", encoding="utf-8") as fh:
        fh.write('{"severity": "P1", "location": "L1"}\n{}\n\nnope\n[{}]\n{"location": "L2"}\r\n')
    found, _ = R.read_findings(spark, tmp_dir, multi_line=False)
    assert [(r.severity, r.location) for r in R.report_detail(found).orderBy("n").collect()] == [("P1", "L1"), ("P3", ""), ("P3", "L2")]
    assert sorted(r.record for r in R.read_rejects(spark, tmp_dir, multi_line=False).collect()) == ["[{}]", "nope"]


def test_numbering_leaves_the_callers_cache(spark):
    f = findings(spark, [("漏翻", "P1", f"L{i}", "d") for i in range(20)]).cache()
    f.count()
    assert R.report_detail(f).count() == 20 and f.storageLevel.useMemory
    f.unpersist()


def test_write_report_status(spark, tmp_dir):
    f = findings(spark, [("漏翻", "P1", "a", "x"), ("增译", "P2", "c", "z")])
    status = R.write_report(f, os.path.join(tmp_dir, "out"), dims="all12", assessment="fine")
    assert status["status"] == "success" and status["findings_count"] == 2
    detail = spark.read.parquet(os.path.join(tmp_dir, "out", "审查结果"))
    assert set(detail.columns) >= {"#", "问题位置", "问题描述", "严重程度", "问题类别"}


def test_size_ratio_golden_rows(spark):
    from polyglint.operators import compare as CMP
    from polyglint.operators.summary import document_counts
    from polyglint.sources.segmenters import line_segments
    # pair 0: source 2 lines, target 3; pair 1: source 2, target 1; pair 2: both empty;
    # pair 3: the target document is absent (failed side)
    docs = spark.createDataFrame(
        [(0, "aa\nbb"), (1, "aa\nbb\ncc"), (2, "aa\nbb"), (3, "aa"), (4, ""), (5, ""), (6, "aa\nbb")],
        "doc_id long, text string")
    counts = document_counts(docs, line_segments("text"))
    roles = spark.createDataFrame([(i // 2, "target" if i % 2 else "source", i) for i in range(8)],
                                  "pair_id long, role string, doc_id long")
    out = {r.pair_id: r for r in CMP.size_ratio(CMP.compare_sections(counts, roles)).collect()}
    assert (out[0].ratio, out[0].size_flag) == (1.5, None)
    assert (out[1].ratio, out[1].size_flag) == (0.5, None)
    assert (out[2].ratio, out[2].size_flag, out[2].size_warning) == (
        0.0, "smaller", "Target is 0.0x smaller than source — possible omissions")
    assert (out[3].target_ok, out[3].target_count, out[3].ratio, out[3].size_warning) == (
        False, 0, None, None)


def test_detail_defaults_and_addition_outside_core10(spark):
    f = findings(spark, [("增译", None, "S!A7", "Added 'abcd' with no source"),
                         (None, "P1", None, None)])
    d = {r.location: r for r in R.report_detail(f).collect()}
    assert (d["S!A7"].severity, d["S!A7"].dimension, d["S!A7"].fill_rgb) == ("P3", "增译", "88CCEE")
    assert (d[""].dimension, d[""].description, d[""].severity) == ("", "", "P1")
    core = {r.dimension: r.total for r in R.report_summary(f, "core10").collect()}
    assert "增译" not in core and core["总计"] == 0
    all12 = {r.dimension: (r.P3, r.total) for r in R.report_summary(f, "all12").collect()}
    assert all12["增译"] == (1, 1) and all12["总计"] == (1, 1)
