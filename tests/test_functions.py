"""Golden edge rows for the scalar functions (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from polyglint import catalog as C
from polyglint.functions import text as X


def one(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_cjk_range(spark):
    got = one(spark, ["一", "鿿", "㐀", "。", "か", "漢字", None], X.has_cjk)
    assert got == [True, True, False, False, False, True, False]


def test_py_strip_matches_python(spark):
    samples = ["\x1c　a​﻿ \t", "  a b  ", " x ", "\x85y\xa0", "", "​z"]
    got = one(spark, samples, X.py_strip)
    assert got == [s.strip() for s in samples]


def test_truncate_and_length_count_code_points(spark):
    s = "漢字😀abc"
    assert one(spark, [s], lambda c: X.truncate_text(c, 3)) == [s[:3]]
    assert one(spark, [s], X.char_count) == [len(s)]


def test_language_rules(spark):
    samples = [" ", None, "中文", "カタ abc", "한글", "ab éé", "abc か", "Straße", "año"]
    got = one(spark, samples, X.detect_language)
    # EN counts runs of 3+ ASCII letters; ties go to the earlier class
    assert got == ["unknown", "unknown", "EN", "JA", "KO", "FR", "EN", "EN", "ES"]


def test_lang_name(spark):
    assert one(spark, ["JA", "xx"], X.lang_name) == ["Japanese", None]


def test_parse_coordinate(spark):
    got = one(spark, ["A1", "AA10", "XFD7", "?", "B2x"], X.parse_coordinate)
    assert [(r.col_no, r.row_no) for r in got] == [(1, 1), (27, 10), (16384, 7), (0, 0), (2, 2)]


def test_a1_round_trip(spark):
    df = spark.range(1, 16385).select(F.col("id").alias("c"))
    out = df.select("c", X.parse_coordinate(X.a1_coordinate("c", F.lit(5))).alias("p")) \
        .filter((F.col("p.col_no") != F.col("c")) | (F.col("p.row_no") != 5))
    assert out.count() == 0
    got = df.filter(F.col("c").isin(1, 26, 27, 52, 702, 703, 16384)) \
        .select(X.column_letters("c")).orderBy(F.col("c")).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]


def test_strip_sheet_suffix_is_a_character_set(spark):
    got = one(spark, ["ORDERS_EN", "Sheet1_EN", "Brand#10_EN", "Data_JA_KO"], X.strip_sheet_suffix)
    assert got == ["", "Sheet1", "Brand#10", "Data"]


def test_file_suffix(spark):
    paths = ["/a/b.MD", "x.tar.gz", ".bashrc", "a.", "dir.d/file", "/p/q.html", "noext"]
    got = one(spark, paths, X.file_suffix)
    assert got == [".md", ".gz", "", "", "", ".html", ""]


def test_compare_mode(spark):
    assert one(spark, ["a/src.XLSX", "b.xls", "c.pdf"], X.compare_mode) == ["excel", "excel", "generic"]


def test_list_repr(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "v array<string>")
    assert [r[0] for r in df.select(X.list_repr("v")).collect()] == ["['a', 'b']", "[]"]


def test_format_ratio_rounds_like_python(spark):
    vals = [0.35, 0.45, 2.25, 0.25, 1234.56, 1 / 3, 7 / 20, 1500.05]
    got = one(spark, vals, X.format_ratio, "v double")
    assert got == [f"{v:.1f}" for v in vals]


def test_locations(spark):
    df = spark.createDataFrame([(3, "Heading 1", None)], "n int, s string, z string")
    r = df.select(X.loc_paragraph("n", "s"), X.loc_paragraph("n", "z"),
                  X.loc_paragraph("n", F.lit("Normal")), X.loc_slide_table("n", "n", "n"),
                  X.loc_html(F.lit("h1"), F.lit("x" * 41))).first()
    assert r[0] == "Paragraph 3 [Heading 1]"
    assert r[1] == "Paragraph 3"
    assert r[2] == "Paragraph 3"
    assert r[3] == "Slide 3, Table Row 3, Col 3"
    assert r[4] == '<h1> "' + "x" * 40 + '..."'


def test_language_rules_as_data(spark):
    rules = [("IT", "[àèìòù]"), ("EN", "[a-zA-Z]{3,}")]
    got = one(spark, ["più già", "plain words", "", "42"], lambda c: X.detect_language(c, rules))
    assert got == ["IT", "EN", "unknown", "IT"]


def test_lists_print_as_python_prints_them(spark):
    values = [[], ["a"], ["l'homme"], ['say "x"'], ["l'\"x\""], ["a\\b", "t\tn\nr\r"], ["\x00\x1b\x7f\xa0\u3000\u200b"],
              ["é中", "😀"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v array<string>")
    got = {r.i: r.s for r in df.select("i", X.list_repr("v").alias("s")).collect()}
    assert got == {i: repr(v) for i, v in enumerate(values)}


def test_language_uses_each_pattern_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(
        X.lang_name(X.detect_language("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") == len(C.LANG_PATTERNS)


def test_language_rules_as_a_table(spark):
    import pytest
    rules = spark.createDataFrame([(2, "FR", "[\u00e0-\u00ff]"), (1, "IT", "[\u00e0\u00f9]"), (3, "NO", "zz")], "ord int, lang string, pattern string")
    assert one(spark, ["pi\u00f9 gi\u00e0", "\u00e9t\u00e9", "words", "zz zz", ""], lambda c: X.detect_language(c, rules)) == ["IT", "FR", "IT", "NO", "unknown"]
    assert one(spark, ["x"], lambda c: X.detect_language(c, rules.limit(0))) == ["unknown"]
    many = spark.range(X.MAX_LANGUAGE_RULES + 1).selectExpr("id as ord", "cast(id as string) as lang", "'x' as pattern")
    with pytest.raises(ValueError, match="language rules"):
        X.language_rules(many)
