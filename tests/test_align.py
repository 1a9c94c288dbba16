"""Sheet matching, cell alignment, classes, consistency."""

from pyspark.sql import functions as F

from polyglint.operators import align as A
from polyglint.plans.review import review_bitext

SCHEMA = ("workbook_id string, sheet string, sheet_idx long, row_no long, col_no long, "
          "value string")


def wb(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sheets(spark, names):
    return wb(spark, [("w", n, i, 1, 1, "x") for i, n in enumerate(names)])


def test_sheet_matching_stages(spark):
    src = sheets(spark, ["Brand#1", "Brand#2", "Summary", "Orders", "Lonely", "Extra1", "Extra2"])
    tgt = sheets(spark, ["Brand#10_EN", "Brand#2", "Brand#1_EN", "Summary_JA", "T4"])
    m = {r.sheet: (r.target_sheet, r.stage) for r in
         A.match_sheets(A.sheets_of(src), A.sheets_of(tgt)).collect()}
    # greedy prefix: Brand#1 takes Brand#10_EN (first in order starting with it)
    assert m["Brand#1"] == ("Brand#10_EN", "prefix")
    assert m["Brand#2"] == ("Brand#2", "exact")
    assert m["Summary"] == ("Summary_JA", "prefix")
    assert m["Orders"] == ("Summary_JA", "position")   # same position 3, shared target
    assert m["Lonely"] == ("T4", "position")
    assert m["Extra1"] == (None, None)


def test_pair_classes(spark):
    src = wb(spark, [("w", "S", 0, 1, 1, "中"), ("w", "S", 0, 2, 1, "中文"), ("w", "S", 0, 3, 1, "abc"),
                     ("w", "S", 0, 4, 1, "same"), ("w", "S", 0, 5, 1, "中")])
    tgt = wb(spark, [("w", "S", 0, 1, 1, "中"), ("w", "S", 0, 4, 1, "same"), ("w", "S", 0, 6, 1, "abc"),
                     ("w", "S", 0, 7, 1, "abcd"), ("w", "S", 0, 5, 1, " ")])
    r = review_bitext(src, tgt, persist=False)
    got = {x.coordinate: x.match for x in r["pairs"].collect()}
    assert got == {"A1": "translated", "A2": "missing", "A3": "modified", "A4": "unchanged",
                   "A5": "missing", "A6": "addition", "A7": "addition"}
    f = r["findings"].collect()
    adds = [x.location for x in f if x.dimension == "增译"]
    assert adds == ["S!A7"]            # 'abc' has length 3: no finding
    assert sorted(x.location for x in f if x.dimension == "漏译") == ["S!A2", "S!A5"]


def test_consistency_counts_non_null_targets(spark):
    rows_s = [("w", "S", 0, i, 1, "中文") for i in range(1, 8)] + \
             [("w", "S", 0, i, 2, "好") for i in range(1, 4)]
    rows_t = [("w", "S", 0, 1, 1, "A"), ("w", "S", 0, 2, 1, "B"), ("w", "S", 0, 3, 1, "C"),
              ("w", "S", 0, 4, 1, "A"), ("w", "S", 0, 5, 1, "A"), ("w", "S", 0, 6, 1, "B"),
              ("w", "S", 0, 1, 2, "good"), ("w", "S", 0, 2, 2, "fine")]
    pairs = review_bitext(wb(spark, rows_s), wb(spark, rows_t), persist=False)["pairs"]
    f = {x.description: x for x in A.consistency_findings(pairs).collect()}
    three = f["'中文' translated 3 ways: ['A', 'B', 'C']"]
    assert three.severity == "P1"
    assert three.location == "A1, A2, A3, A4, A5"     # first five, column-major
    two = f["'好' translated 2 ways: ['fine', 'good']"]
    assert two.severity == "P2" and two.location == "B1, B2, B3"


def test_consistency_under_a_hot_source(spark):
    """One source text holding most rows: results stay whole and the first
    coordinates are exact."""
    n = 20000
    src = spark.range(1, n + 1).select(F.lit("w").alias("workbook_id"), F.lit("S").alias("sheet"),
                                       F.lit(0).cast("long").alias("sheet_idx"),
                                       F.col("id").alias("row_no"), F.lit(1).cast("long").alias("col_no"),
                                       F.lit("常用").alias("value"))
    tgt = src.withColumn("value", F.when(F.col("row_no") % 3 == 0, "common")
                         .when(F.col("row_no") % 3 == 1, "usual").otherwise("frequent"))
    pairs = review_bitext(src.repartition(16), tgt.repartition(16), persist=False)["pairs"]
    stats = A.consistency_counts(pairs).collect()
    assert len(stats) == 1 and stats[0].occurrences == n and stats[0].n_translations == 3
    f = A.consistency_findings(pairs).collect()
    assert f[0].location == "A1, A2, A3, A4, A5"


def test_match_stats_and_sheet_alignment(spark):
    src = wb(spark, [("w", "S", 0, 1, 1, "中"), ("w", "S", 0, 2, 1, "x"), ("w", "T", 1, 1, 1, "y")])
    tgt = wb(spark, [("w", "S", 0, 1, 1, "z")])
    r = review_bitext(src, tgt, persist=False)
    stats = {(x.sheet, x.match): x.n for x in r["stats"].collect()}
    assert stats == {("S", "translated"): 1, ("S", "modified"): 1,
                     (None, "translated"): 1, (None, "modified"): 1}
    al = r["sheets"].collect()
    assert [(x.sheet, x.target_sheet, x.pairs) for x in al] == [("S", "S", 2)]
    miss = [x for x in r["findings"].collect() if x.detector == "missing_sheet"]
    assert miss[0].location == "Sheet: T" and miss[0].dimension == "漏翻"


def test_options_unmatched_targets_and_script_class(spark):
    from polyglint.functions import text as X
    src = wb(spark, [("w", "A", 0, 1, 1, "中文")])
    tgt = wb(spark, [("w", "A", 0, 1, 1, "text"), ("w", "Extra", 1, 1, 1, "orphan cell"),
                     ("w", "Extra", 1, 2, 1, "abc")])
    plain = review_bitext(src, tgt, persist=False)["findings"].collect()
    assert not [f for f in plain if f.detector == "unpicked_target"]
    opt = review_bitext(src, tgt, persist=False, report_unmatched_targets=True)["findings"]
    extra = [f for f in opt.collect() if f.detector == "unpicked_target"]
    assert [(f.location, f.dimension) for f in extra] == [("Extra!A1", "增译")]
    df = spark.createDataFrame([("カタカナ",), ("漢",)], "v string")
    kana = "[ぁ-ゟ゠-ヿ]"
    assert [r[0] for r in df.select(X.has_cjk("v", kana)).collect()] == [True, False]


def test_checkpointed_pairs_match_persisted(spark):
    from polyglint.plans import fixtures as FX
    from conftest import SF_SMALL
    src, tgt = FX.fx_src(spark, SF_SMALL), FX.fx_tgt(spark, SF_SMALL)
    a = review_bitext(src, tgt)["findings"]
    b = review_bitext(src, tgt, materialize="checkpoint")["findings"]
    cols = ["location", "description", "severity"]
    assert a.count() == b.count() > 0
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


def test_sheet_lists_and_workbooks_without_cells(spark):
    """Sheets without cells are matched by name; workbooks without pairs have
    totals."""
    src = wb(spark, [("w", "A", 0, 1, 1, "中文"), ("w", "A", 0, 2, 1, "中"), ("v", "B", 0, 1, 1, "无")])
    tgt = wb(spark, [("w", "Z", 1, 1, 1, "text")])
    sheets = "workbook_id string, sheet string, sheet_idx long"
    tgt_sheets = spark.createDataFrame([("w", "A", 0), ("w", "Z", 1)], sheets)
    src_sheets = spark.createDataFrame([("w", "A", 0), ("v", "B", 0), ("u", "C", 0)], sheets)
    r = review_bitext(src, tgt, persist=False, src_sheets=src_sheets, tgt_sheets=tgt_sheets)
    m = {x.sheet: (x.target_sheet, x.stage) for x in r["sheet_map"].collect()}
    assert m == {"A": ("A", "exact"), "B": (None, None), "C": (None, None)}
    assert sorted(f.detector for f in r["findings"].collect()) == ["missing_sheet", "missing_sheet", "omission", "omission"]
    totals = {t.workbook_id: (t.total_pairs, t.total_findings) for t in r["totals"].collect()}
    assert totals == {"w": (2, 2), "v": (0, 1), "u": (0, 1)}
    cons = {t.workbook_id: (t.total_unique, t.issues) for t in r["consistency_totals"].collect()}
    assert cons == {"w": (2, 0), "v": (0, 0), "u": (0, 0)}


def test_issue_rows(spark):
    src = wb(spark, [("w", "S", 0, i, 1, "好") for i in range(1, 5)])
    tgt = wb(spark, [("w", "S", 0, 1, 1, "l'un"), ("w", "S", 0, 2, 1, "fine"), ("w", "S", 0, 3, 1, "fine")])
    pairs = review_bitext(src, tgt, persist=False)["pairs"]
    assert sorted((r.target, r.n) for r in A.issue_translations(pairs).collect()) == [("fine", 2), ("l'un", 1)]
    assert sorted((r.coordinate, r.target) for r in A.issue_occurrences(pairs).collect()) == [
        ("A1", "l'un"), ("A2", "fine"), ("A3", "fine"), ("A4", None)]
    assert A.consistency_findings(pairs).first().description == "'好' translated 2 ways: ['fine', \"l'un\"]"


def test_cells_are_never_the_broadcast_side_of_their_sheets(spark, tmp_dir):
    """The positions of the sheets go to the cells, not the cells to them."""
    from polyglint.plans import fixtures as FX
    from polyglint.plans.review import align_bitext
    spark.createDataFrame([(i, f"name {i}", f"Brand#{i % 7 + 1}", i % 50) for i in range(200)],
                          "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_dir}/part.parquet")
    spark.createDataFrame([(1, t, r, f"text {t}") for t, r in enumerate(["user", "assistant"] * 3)],
                          "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    src, tgt = FX.fx_src(spark, tmp_dir), FX.fx_tgt(spark, tmp_dir)
    for cells in (tgt, FX.fx_conv_cells(spark, tmp_dir)):
        plan = A.sheets_of(cells)._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan
    # brand 1 has no sheet: 2..7 are at 0..5
    assert {(r.sheet, r.sheet_idx) for r in tgt.select("sheet", "sheet_idx").distinct().collect()} == {
        ("Brand#2", 0), *((f"Brand#{n}_EN", n - 2) for n in range(3, 8))}
    sheet_map, _ = align_bitext(src, tgt)
    assert {(r.sheet, r.target_sheet) for r in sheet_map.collect()} == {
        ("Brand#1", "Brand#2"), ("Brand#2", "Brand#2"), *((f"Brand#{n}", f"Brand#{n}_EN") for n in range(3, 8))}
