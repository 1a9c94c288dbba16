"""Derived inputs built from the bundled tables.

The bundled prose holds no CJK character and no sensitive term, so the
checks would return nothing on the raw tables.  These views derive, with
plain column expressions over *every* row of the given tables, the inputs
the review operators expect: a bilingual workbook from ``part``, injected
terms in ``documents``, markdown fences, conversations as a workbook or a
slide deck, and so on.  Modulo predicates below choose *which* rows get a
variation (a dropped cell, an upper-cased translation); they never restrict
the rows processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import sheet_position
from ..session import read_table
from ..sources.segmenters import explode_lines, segment_lines

PART_WORKBOOK = "part"
CJK_VOWELS = "一二三四五"


def _brand_no(c="p_brand"):
    return F.substring(F.col(c), 7, 10).cast("int")


def _part(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")


def fx_src(spark: SparkSession, d: str) -> DataFrame:
    """Source workbook: one sheet per brand; column 1 = pseudo-Chinese name
    (vowels replaced by CJK characters, every 19th part left out), column 2
    = size."""
    p = _part(spark, d)
    base = [F.lit(PART_WORKBOOK).alias("workbook_id"),
            (_brand_no() - 1).cast("bigint").alias("sheet_idx"),
            F.col("p_brand").alias("sheet"),
            (F.col("p_partkey") + 1).cast("bigint").alias("row_no")]
    c1 = p.filter(F.col("p_partkey") % 19 != 0).select(
        *base, F.lit(1).cast("bigint").alias("col_no"),
        F.translate("p_name", "aeiou", CJK_VOWELS).alias("value"))
    c2 = p.select(*base, F.lit(2).cast("bigint").alias("col_no"),
                  F.col("p_size").cast("string").alias("value"))
    return c1.unionByName(c2)


def fx_tgt(spark: SparkSession, d: str) -> DataFrame:
    """Target workbook: sheets named ``<brand>_EN`` (``Brand#2`` keeps its
    name); brands 1, 9 and 25 have no sheet; some cells are dropped, some
    translations upper-cased or left partly in CJK, some sizes changed."""
    p = _part(spark, d).filter(~F.col("p_brand").isin("Brand#1", "Brand#9", "Brand#25"))
    sheet = F.when(F.col("p_brand") == "Brand#2", F.col("p_brand")) \
        .otherwise(F.concat("p_brand", F.lit("_EN")))
    base = [F.lit(PART_WORKBOOK).alias("workbook_id"), sheet.alias("sheet"),
            _brand_no().alias("ord"), (F.col("p_partkey") + 1).cast("bigint").alias("row_no")]
    v1 = (F.when(F.col("p_partkey") % 13 == 0, F.upper("p_name"))
          .when(F.col("p_partkey") % 11 == 0, F.translate("p_name", "a", "一"))
          .otherwise(F.col("p_name")))
    c1 = p.filter(F.col("p_partkey") % 17 != 0).select(
        *base, F.lit(1).cast("bigint").alias("col_no"), v1.alias("value"))
    v2 = F.when(F.col("p_partkey") % 23 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    c2 = p.filter(F.col("p_partkey") % 31 != 0).select(
        *base, F.lit(2).cast("bigint").alias("col_no"), v2.cast("string").alias("value"))
    cells = c1.unionByName(c2)
    # sheet position = rank of the brand number among the target's sheets
    # (distinct sheets of one workbook, which were one row: a handful).  Said to
    # be the broadcast side, as Spark's guess takes the cells for the smaller one
    ranked = sheet_position(cells.select("workbook_id", "sheet", "ord"))
    return cells.join(F.broadcast(ranked), ["workbook_id", "sheet"]) \
        .select("workbook_id", "sheet", "sheet_idx", "row_no", "col_no", "value")


def tgt_sheet_names(spark: SparkSession, d: str) -> DataFrame:
    """(workbook_id, sheet, ord): the target workbook's sheets, unnumbered."""
    t = fx_tgt(spark, d).select("workbook_id", "sheet").distinct()
    return t.withColumn("ord", F.regexp_extract("sheet", "[0-9]+", 0).cast("int"))


def listed_sheets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sheet lists of both workbooks with sheets that have no cells: the
    target has ``Brand#1`` (empty) in front of its sheets, the source a last
    sheet ``Notes``."""
    src = fx_src(spark, d).select("workbook_id", "sheet", "sheet_idx").distinct()
    more = src.groupBy("workbook_id").agg((F.max("sheet_idx") + 1).alias("sheet_idx")).select(
        "workbook_id", F.lit("Notes").alias("sheet"), "sheet_idx")
    names = tgt_sheet_names(spark, d)
    empty = names.select("workbook_id", F.lit("Brand#1").alias("sheet"), F.lit(0).alias("ord")).distinct()
    return src.unionByName(more), sheet_position(names.unionByName(empty))


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Workbook ids: the bilingual one and one for each region, without cells."""
    return read_table(spark, d, "region").select(
        F.concat(F.lit("empty-"), F.col("r_name")).alias("workbook_id")).unionByName(
            _part(spark, d).select(F.lit(PART_WORKBOOK).alias("workbook_id")).distinct())


def conv_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Sheet list of the conversation workbook, with an empty sheet ``zz``."""
    s = fx_conv_cells(spark, d).select("workbook_id", "sheet", "sheet_idx").distinct()
    return s.unionByName(s.groupBy("workbook_id").agg((F.max("sheet_idx") + 1).alias("sheet_idx")).select(
        "workbook_id", F.lit("zz").alias("sheet"), "sheet_idx"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def fx_lines(spark: SparkSession, d: str) -> DataFrame:
    """Text-file segments of every document."""
    return segment_lines(documents(spark, d).select("doc_id", "text"))


SENSITIVE_PREFIX = [  # doc_id % 10 -> text put in front of the document
    (0, "Taiwan "),
    (1, "the taiwan strait and "),
    (2, "hack hacke Hacker cracker "),
    (3, "Security exploit "),
    (4, "illegal drug attack "),
]


def fx_sensitive(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a sensitive-term prefix chosen by ``doc_id % 10``."""
    docs = documents(spark, d)
    k = F.col("doc_id") % 10
    prefix = F.lit("")
    expr = None
    for r, txt in SENSITIVE_PREFIX:
        expr = F.when(k == r, F.lit(txt)) if expr is None else expr.when(k == r, F.lit(txt))
    prefix = expr.otherwise(F.lit(""))
    return docs.select("doc_id", "lang", F.concat(prefix, F.col("text")).alias("text"))


def fx_sensitive_lines(spark: SparkSession, d: str) -> DataFrame:
    return segment_lines(fx_sensitive(spark, d).select("doc_id", "text"))


def fx_sensitive_cells(spark: SparkSession, d: str) -> DataFrame:
    """The sensitive corpus as workbooks: one workbook per document
    (``doc<id>``) with one sheet, one cell per line in column A."""
    lines = explode_lines(fx_sensitive(spark, d).select("doc_id", "text"))
    return lines.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("workbook_id"),
        F.lit("Sheet1").alias("sheet"),
        F.lit(0).cast("bigint").alias("sheet_idx"),
        F.col("line_no").alias("row_no"), F.lit(1).cast("bigint").alias("col_no"),
        F.col("raw").alias("value"))


def fx_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents turned into markdown: every 4th gets a title and a closed
    fence, the next one an unclosed fence (so it yields nothing)."""
    docs = documents(spark, d)
    k = F.col("doc_id") % 4
    nl = F.lit("\n")
    text = (F.when(k == 0, F.concat(F.lit("# Title"), nl, F.lit("```"), nl, F.lit("code"), nl,
                                    F.lit("```"), nl, F.col("text")))
            .when(k == 1, F.concat(F.lit("```py"), nl, F.col("text")))
            .otherwise(F.col("text")))
    return docs.select("doc_id", text.alias("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages")


def fx_nested_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages with nested elements, character references and bare ``<`` put in
    front of their own blocks."""
    p = pages(spark, d)
    n, url = F.col("page_id").cast("string"), F.col("url")
    front = F.concat(
        F.lit("<ul><li>Item "), n, F.lit(" &eacute;&#20013;&#x6587; a < b<div> inner <b>"), url,
        F.lit("</b>&nbsp;</div> tail<li>next &amp;lt; &unknown; &lt;x&gt;</ul><table><tr><td>Cell <p> para &rsquo;x&rsquo; "), n,
        F.lit("</p> end</td></tr></table>"))
    return p.select("page_id", F.concat(front, F.col("html")).alias("html"))


def doc_roles(docs: DataFrame) -> DataFrame:
    """Documents 2k + 1 (source) and 2k (target) as pair k, with string ids; pair
    -1 has a target that doesn't exist."""
    k = F.col("doc_id")
    name = F.concat(F.lit("doc-"), k.cast("string"))
    pairs = docs.select(F.floor(k / 2).cast("bigint").alias("pair_id"),
                        F.when(k % 2 == 1, "source").otherwise("target").alias("role"), name.alias("doc_id"))
    lost = docs.where(k == 0).select(F.explode(F.array(
        F.struct(F.lit("source").alias("role"), name.alias("doc_id")),
        F.struct(F.lit("target").alias("role"), F.lit("doc-lost").alias("doc_id")))).alias("x"))
    return pairs.unionByName(lost.select(F.lit(-1).cast("bigint").alias("pair_id"), "x.role", "x.doc_id"))


def fx_routed(spark: SparkSession, d: str) -> DataFrame:
    """A mixed corpus with file paths: documents under several suffixes
    (markdown, plain text, csv, none) and web pages as ``.html``."""
    docs = fx_markdown(spark, d)
    k = F.col("doc_id") % 5
    suffix = (F.when(k == 0, ".md").when(k == 1, ".TXT").when(k == 2, ".markdown")
              .when(k == 3, ".csv").otherwise(""))
    a = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"),
                    F.concat(F.lit("/corpus/doc"), F.col("doc_id").cast("string"), suffix)
                    .alias("path"), "text")
    b = pages(spark, d).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("doc_id"),
        F.concat(F.lit("/corpus/page"), F.col("page_id").cast("string"), F.lit(".HTM"))
        .alias("path"), F.col("html").alias("text"))
    return a.unionByName(b)


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations")


def fx_conv_cells(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a workbook: one sheet per role (alphabetical
    position), row = conversation + 1, column = turn + 1."""
    c = conversations(spark, d)
    ranked = sheet_position(c.select(F.lit("conversations").alias("workbook_id"), F.col("role").alias("sheet"),
                                     F.col("role").alias("ord")))
    return c.withColumnRenamed("role", "sheet").join(F.broadcast(ranked), "sheet").select(
        "workbook_id", "sheet",
        "sheet_idx", (F.col("conv_id") + 1).cast("bigint").alias("row_no"),
        (F.col("turn") + 1).cast("bigint").alias("col_no"), F.col("text").alias("value"))


def fx_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Word paragraphs: one paragraph per line; the first is a
    Title, every 5th a Heading 2, every 7th has no style, the rest Normal."""
    lines = explode_lines(documents(spark, d).select("doc_id", "text"))
    n = F.col("line_no")
    style = (F.when(n == 1, "Title").when(n % 5 == 0, "Heading 2")
             .when(n % 7 == 0, F.lit(None).cast("string")).otherwise("Normal"))
    return lines.select("doc_id", n.alias("para_no"), style.alias("style"),
                        F.col("raw").alias("text"))


def fx_part_tables(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a table grid: document = brand number, row = part + 1,
    columns name, type, size."""
    p = read_table(spark, d, "part")
    base = [_brand_no().cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("table_no"),
            (F.col("p_partkey") + 1).cast("bigint").alias("row_no")]
    cols = [("p_name", 1), ("p_type", 2), ("p_size", 3)]
    out = None
    for c, i in cols:
        part = p.select(*base, F.lit(i).cast("bigint").alias("col_no"),
                        F.col(c).cast("string").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def fx_page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Parts as PDF tables: page = size."""
    t = fx_part_tables(spark, d)
    p = read_table(spark, d, "part").select(
        (F.col("p_partkey") + 1).cast("bigint").alias("row_no"),
        F.col("p_size").cast("bigint").alias("page_no"))
    return t.join(p, "row_no").select("doc_id", "page_no", "table_no", "row_no", "col_no", "text")


def fx_slides(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as decks: slide = turn + 1, one text shape per slide,
    one paragraph per line of the turn."""
    c = conversations(spark, d)
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return lines.select(F.col("conv_id").alias("doc_id"),
                        (F.col("turn") + 1).cast("bigint").alias("slide_no"),
                        F.lit(1).cast("bigint").alias("shape_no"),
                        (F.col("pos") + 1).cast("bigint").alias("para_no"),
                        F.col("raw").alias("text"))


def fx_slide_tables(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a table on slide 1: row = turn + 1, columns role, text."""
    c = conversations(spark, d)
    base = [F.col("conv_id").alias("doc_id"), F.lit(1).cast("bigint").alias("slide_no"),
            F.lit(2).cast("bigint").alias("shape_no"),
            (F.col("turn") + 1).cast("bigint").alias("row_no")]
    a = c.select(*base, F.lit(1).cast("bigint").alias("col_no"), F.col("role").alias("text"))
    b = c.select(*base, F.lit(2).cast("bigint").alias("col_no"), F.col("text"))
    return a.unionByName(b)


def fx_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as PDF pages: page = turn + 1."""
    c = conversations(spark, d)
    return c.select(F.col("conv_id").alias("doc_id"),
                    (F.col("turn") + 1).cast("bigint").alias("page_no"), "text")


def fx_register(spark: SparkSession, d: str) -> DataFrame:
    """Documents with address forms put in: some mix formal and informal
    address, some use one form only."""
    docs = documents(spark, d)
    k = F.col("doc_id") % 6
    t = F.col("text")
    text = (F.when(k == 0, F.concat(F.lit("Sie "), t, F.lit(" du.")))
            .when(k == 1, F.concat(F.lit("Vous "), t, F.lit(" tu.")))
            .when(k == 2, F.concat(F.lit("usted "), t, F.lit(" Tú.")))
            .when(k == 3, F.concat(F.lit("Sie "), t))
            .otherwise(t))
    return docs.select("doc_id", "lang", text.alias("text"))


def fx_jako(spark: SparkSession, d: str) -> DataFrame:
    """Documents with Japanese / Korean sentence endings put in place of the
    full stops: polite only, polite + plain, formal only, polite + formal."""
    docs = documents(spark, d)
    k = F.col("doc_id") % 4
    t = F.col("text")
    text = (F.when(k == 0, F.replace(t, F.lit("."), F.lit("です。")))
            .when(k == 1, F.concat(F.replace(t, F.lit("."), F.lit("ます。")), F.lit("そうだ。")))
            .when(k == 2, F.replace(t, F.lit("."), F.lit("습니다.")))
            .otherwise(F.concat(F.replace(t, F.lit("."), F.lit("해요.")), F.lit("합니다."))))
    return docs.select("doc_id", text.alias("text"))


def fx_fullwidth_lines(spark: SparkSession, d: str) -> DataFrame:
    """Document lines where every third document uses full-width commas."""
    docs = documents(spark, d)
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(", "), F.lit("，"))) \
        .otherwise(F.col("text"))
    return segment_lines(docs.select("doc_id", text.alias("text")))


def fx_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Glossary from the part names: each distinct word, written the way the
    source workbook writes it, must be rendered as the plain word."""
    p = read_table(spark, d, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("approved")).distinct()
    return words.select(F.translate("approved", "aeiou", CJK_VOWELS).alias("term"), "approved")


def findings_files(spark: SparkSession, d: str) -> DataFrame:
    """(part, text): files of findings, one JSON value each, from the labels of
    twenty documents: lists, objects with an assessment, empty objects and
    broken lists by turns.  Some entries say nothing, or nothing known."""
    doc = F.col("doc_id").cast("string")
    item = (F.when(F.col("doc_id") % 5 == 0, "{}").when(F.col("doc_id") % 5 == 1, '{"note": 1}')
            .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('"'), doc, F.lit('"')))
            .otherwise(F.concat(F.lit('{"severity": "P'), F.col("quality").cast("string"), F.lit('", "location": "Document '), doc,
                                F.lit('", "dimension": "\u5730\u9053\u6027"}'))))
    labels = read_table(spark, d, "labels").select(F.floor(F.col("doc_id") / 20).cast("bigint").alias("part"), "doc_id", item.alias("item"))
    parts = labels.groupBy("part").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), ", ").alias("items"))
    text = (F.when(F.col("part") % 4 == 0, F.concat(F.lit("["), "items", F.lit("]")))
            .when(F.col("part") % 4 == 1, F.concat(F.lit('{"assessment": "part '), F.col("part").cast("string"),
                                                   F.lit('", "findings": ['), "items", F.lit("]}")))
            .when(F.col("part") % 4 == 2, "{}").otherwise(F.concat(F.lit("["), "items", F.lit(","))))
    return parts.select("part", text.alias("text"))
