"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the bundled tables (or inputs
derived from them in ``fixtures``) and returns a DataFrame whose columns
match the DuckDB oracle of the same name in ``oracle``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import text as X
from ..operators import align as A
from ..operators import checks as K
from ..operators import compare as CMP
from ..operators import report as R
from ..operators import rulepacks as RP
from ..operators import summary as S
from ..session import checkpoint_dir, read_table, spread_scan
from ..sources import readers as RD
from ..sources import segmenters as G
from . import fixtures as FX
from .review import align_bitext, bitext_findings, corpus_counts
from .strategy import number_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROWS_ONLY: set[str] = set()   # queries without an oracle (checked by rows only)


def q(name: str, rows_only: bool = False):
    def deco(fn):
        QUERIES[name] = fn
        if rows_only:
            ROWS_ONLY.add(name)
        return fn
    return deco


# --------------------------------------------------------------------------
# shared derived inputs
# --------------------------------------------------------------------------

_SHARED: dict[tuple, object] = {}


def shared(fn):
    """Build a shared input once per application and scale directory: the
    queries of one run reuse the same DataFrame (and its persisted data)
    instead of planning it again."""
    def wrapper(spark, d):
        key = (spark.sparkContext.applicationId, d, fn.__name__)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, d)
        return _SHARED[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


def forget_shared(spark: SparkSession) -> None:
    """Drop the shared inputs and everything that is cached."""
    _SHARED.clear()
    spark.catalog.clearCache()


@shared
def _bitext(spark, d):
    """The aligned workbook.  The sheet map and the pairs feed several
    outputs, so they are persisted (identical plans share one cache entry
    across queries); the sheet map is broadcast behind a row-count check."""
    src, tgt = FX.fx_src(spark, d), FX.fx_tgt(spark, d)
    sheet_map, pairs = align_bitext(src, tgt, persist=True)
    return src, tgt, sheet_map, pairs


def _pairs(spark, d):
    return _bitext(spark, d)[3]


@shared
def _bitext_findings(spark, d):
    _, _, sm, pairs = _bitext(spark, d)
    return bitext_findings(pairs, sm)


@shared
def _report_findings(spark, d):
    """Everything the automated passes find on the derived inputs: the
    bilingual workbook (sheets, omissions, additions, consistency), CJK left
    in its target cells, and sensitive terms in the document lines.  The
    report outputs (detail, summary, groupings) all read it, so it is
    persisted; findings are sparse next to the corpus."""
    tgt_segments = G.segment_cells(FX.fx_tgt(spark, d), admit="nonnull")
    sensitive = K.document_findings(FX.fx_sensitive(spark, d).select("doc_id", "text"),
                                    G.segment_lines, "extended7", include_residual=False)
    return R.merge_findings(
        _bitext_findings(spark, d),
        K.residual_findings(tgt_segments),
        sensitive).persist(StorageLevel.MEMORY_AND_DISK)


def _manual_findings(spark, d):
    """Reader judgements taken from ``labels``: toxic documents are a
    sensitive-content finding (P0); low-quality ones an idiomaticity note
    with no severity (the report files it as P3)."""
    lab = read_table(spark, d, "labels")
    toxic = lab.filter(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("manual").alias("detector"),
        F.lit(C.DIM_SENSITIVE).alias("dimension"), F.lit("P0").alias("severity"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("location"),
        F.lit("Reader: toxic content").alias("description"),
        F.lit(0).cast("bigint").alias("phase"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(0).cast("bigint").alias("sub"))
    low = lab.filter((F.col("quality") == 0) & (F.col("toxic") != 1)).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("manual").alias("detector"),
        F.lit("地道性").alias("dimension"), F.lit(None).cast("string").alias("severity"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("location"),
        F.lit("Reader: low quality").alias("description"),
        F.lit(0).cast("bigint").alias("phase"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(1).cast("bigint").alias("sub"))
    return toxic.unionByName(low)


def _io_dir(spark, name):
    return os.path.join(checkpoint_dir(spark), "polyglint-io", f"{name}-{uuid.uuid4().hex}")


FINDING_VIEW = ["doc_id", "detector", "dimension", "severity", "location", "description",
                "phase", "seq", "sub"]


# --------------------------------------------------------------------------
# 2.1 sources, segmenters, sinks
# --------------------------------------------------------------------------

@q("load_documents")
def load_documents(spark, d):
    raw = read_table(spark, d, "documents", spread=False)
    return spread_scan(raw.select("doc_id", "text",
                                  F.col("_metadata.file_name").alias("file_name")))


def _text_files(spark, d):
    """Documents written as text files of fifty, and where they are."""
    path = _io_dir(spark, "text")
    docs = FX.documents(spark, d).select(F.floor(F.col("doc_id") / 50).cast("bigint").alias("part"), "doc_id", "text")
    (docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text")
     .write.partitionBy("part").text(path))
    return path


def _part_of(path):
    return F.regexp_extract(path, r"part=([0-9]+)", 1).cast("bigint").alias("part")


@q("load_text_files")
def load_text_files(spark, d):
    """The whole-file reader: one row a file, told by its path."""
    files = RD.load_text_files(spark, _text_files(spark, d))
    return files.select(_part_of("path"), F.length("text").cast("bigint").alias("n_chars"),
                        F.md5(F.col("text").cast("binary")).alias("digest"))


@q("segment_text_lines")
def segment_text_lines(spark, d):
    """The same files read in splits."""
    lines = RD.segment_text_lines(RD.load_text_lines(spark, _text_files(spark, d)))
    return lines.select(_part_of("doc_id"), "seq", "location", "text")


@q("route_format")
def route_format(spark, d):
    return G.route_format(FX.fx_routed(spark, d)).select("doc_id", "path", "suffix", "format",
                                                         "parser")


@q("segment_routed")
def segment_routed(spark, d):
    return G.segment_routed(FX.fx_routed(spark, d))


@q("segment_lines")
def segment_lines(spark, d):
    return FX.fx_lines(spark, d)


@q("segment_markdown")
def segment_markdown(spark, d):
    return G.segment_markdown(FX.fx_markdown(spark, d))


@q("segment_html")
def segment_html(spark, d):
    return G.segment_html(FX.pages(spark, d))


@q("segment_html_nested")
def segment_html_nested(spark, d):
    """Nested elements, character references and bare ``<``."""
    return G.segment_html(FX.fx_nested_html(spark, d))


@q("unsegmented")
def unsegmented(spark, d):
    """Documents whose format comes as decoded tables."""
    docs = FX.documents(spark, d).select("doc_id", F.concat(
        F.lit("/in/"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 3 == 0, ".DOCX").when(F.col("doc_id") % 3 == 1, ".pdf").otherwise(".md")).alias("path"))
    return G.unsegmented(docs)


@q("segment_cells")
def segment_cells(spark, d):
    return G.segment_cells(FX.fx_tgt(spark, d), admit="truthy")


@q("cell_map")
def cell_map(spark, d):
    return G.cell_map(FX.fx_src(spark, d))


@q("scan_cells")
def scan_cells(spark, d):
    return G.scan_cells(FX.fx_conv_cells(spark, d))


@q("segment_paragraphs")
def segment_paragraphs(spark, d):
    return G.segment_paragraphs(FX.fx_paragraphs(spark, d))


def _shown(segments):
    """Places made of several ordinals, as text: both engines write those alike."""
    return segments.withColumn("seq", F.col("seq").cast("string"))


@q("segment_doc_tables")
def segment_doc_tables(spark, d):
    return _shown(G.segment_doc_tables(FX.fx_part_tables(spark, d)))


@q("segment_slides")
def segment_slides(spark, d):
    return _shown(G.segment_slides(FX.fx_slides(spark, d)))


@q("segment_slide_tables")
def segment_slide_tables(spark, d):
    return _shown(G.segment_slide_tables(FX.fx_slide_tables(spark, d)))


@q("segment_page_lines")
def segment_page_lines(spark, d):
    return _shown(G.segment_page_lines(FX.fx_page_texts(spark, d)))


@q("segment_page_tables")
def segment_page_tables(spark, d):
    return _shown(G.segment_page_tables(FX.fx_page_tables(spark, d)))


@q("write_review")
def write_review(spark, d):
    """Findings written as parquet partitioned by severity, read back."""
    path = _io_dir(spark, "write_review")
    R.write_review(_bitext_findings(spark, d), path, fmt="parquet", partition_by=["severity"])
    return spark.read.parquet(path).select(*FINDING_VIEW)


@q("read_findings")
def read_findings(spark, d):
    """Findings written as JSON lines, read back through the findings reader."""
    path = _io_dir(spark, "read_findings")
    R.write_review(_bitext_findings(spark, d).select("dimension", "severity", "location",
                                                     "description"), path, fmt="json")
    found, _ = R.read_findings(spark, path, multi_line=False)
    return found.select("dimension", "severity", "location", "description")


@q("read_findings_files")
def read_findings_files(spark, d):
    """Files of each kind (a list with {} and unknown keys, an object, {} and a
    broken one), made from ``labels``: findings as the report shows them,
    assessments and rejects."""
    path = _io_dir(spark, "files")
    FX.findings_files(spark, d).repartition("part").write.partitionBy("part").text(path)
    found, assessments = R.read_findings(spark, path)
    rows = R.with_defaults(found).select(_part_of("file"), F.lit("finding").alias("what"), "severity", "location", "dimension")
    others = [df.select(_part_of("file"), F.lit(what).alias("what"), F.lit("").alias("severity"), F.col(c).alias("location"),
                        F.lit("").alias("dimension"))
              for df, what, c in ((assessments, "assessment", "assessment"), (R.read_rejects(spark, path), "reject", "record"))]
    return rows.unionByName(others[0]).unionByName(others[1])


@q("report_detail")
def report_detail(spark, d):
    return R.report_detail(_report_findings(spark, d))


@q("run_status")
def run_status(spark, d):
    path = _io_dir(spark, "report")
    status = R.write_report(_report_findings(spark, d), path, dims="all12")
    return spark.createDataFrame([(status["status"], status["findings_count"],
                                   ",".join(status["sheets"]))],
                                 "status string, findings_count bigint, sheets string")


# --------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# --------------------------------------------------------------------------

@q("has_cjk")
def has_cjk(spark, d):
    return FX.fx_tgt(spark, d).select("workbook_id", "sheet", "row_no", "col_no", "value",
                                      X.has_cjk("value").alias("has_cjk"))


@q("residual_findings")
def residual_findings(spark, d):
    return K.residual_findings(G.segment_cells(FX.fx_tgt(spark, d), admit="nonnull"))


@q("residual_findings_cells")
def residual_findings_cells(spark, d):
    return K.residual_findings_cells(G.scan_cells(FX.fx_tgt(spark, d)))


@q("sensitive_matches")
def sensitive_matches(spark, d):
    m = K.sensitive_matches(FX.fx_sensitive_lines(spark, d), "extended7")
    return m.select("doc_id", "seq", "rule_no", "rule_id", "match_no", "term", "severity")


@q("sensitive_matches_large")
def sensitive_matches_large(spark, d):
    """A pack with a literal rule for each word that part names hold."""
    parts = read_table(spark, d, "part").select("p_partkey", "p_name")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("w")).where("w rlike '^[a-z]+$'").distinct()
    pack = words.select(F.col("w").alias("rule_id"), F.concat(F.lit(r"\b("), "w", F.lit(r")\b")).alias("pattern"),
                        F.lit("P2").alias("severity"), F.lit("listed").alias("description"),
                        F.lit(None).cast("string").alias("exempt_if_contains"))
    return K.sensitive_matches(parts, pack, "p_name").select("p_partkey", "rule_id", "match_no", "term", "severity")


@q("sensitive_exempt")
def sensitive_exempt(spark, d):
    """Hits of the security rule that the exemption removes."""
    lines = FX.fx_sensitive_lines(spark, d)
    rule = [r for r in C.RULES_EXTENDED7 if r[0] == "security"][0]
    hits = lines.select("doc_id", "seq", "text",
                        F.posexplode(F.regexp_extract_all("text", F.lit(K.rule_pattern(rule[1])), 0))
                        .alias("match_no", "term"))
    return hits.filter(F.lower("text").contains("security")).select(
        "doc_id", "seq", F.col("match_no").cast("bigint").alias("match_no"), "term")


@q("sensitive_findings")
def sensitive_findings(spark, d):
    return K.sensitive_findings(FX.fx_sensitive_lines(spark, d), "basic5")


@q("sensitive_findings_cells")
def sensitive_findings_cells(spark, d):
    return K.sensitive_findings_cells(G.scan_cells(FX.fx_sensitive_cells(spark, d)), "extended7")


@q("document_findings")
def document_findings(spark, d):
    """Findings of the sensitive corpus with the document pre-filter: only
    documents that can hold a finding are split into lines."""
    return K.document_findings(FX.fx_sensitive(spark, d).select("doc_id", "text"),
                               G.segment_lines, "basic5")


@q("dedup_findings")
def dedup_findings(spark, d):
    """Residual + sensitive findings checked once per distinct line text and
    joined back to every segment holding it."""
    return K.automated_findings(FX.fx_sensitive_lines(spark, d), "extended7", dedup=True)


@q("nonblank_filter")
def nonblank_filter(spark, d):
    s = FX.fx_slides(spark, d)
    return G.nonblank_filter(s, min_len=1).select("doc_id", "slide_no", "para_no", "text")


@q("source_gate")
def source_gate(spark, d):
    segs = FX.fx_sensitive_lines(spark, d).withColumn("is_source", F.col("doc_id") % 2 == 1)
    return K.automated_findings(segs, "basic5")


@q("omission_findings")
def omission_findings(spark, d):
    return A.omission_findings(_pairs(spark, d))


@q("addition_findings")
def addition_findings(spark, d):
    return A.addition_findings(_pairs(spark, d))


@q("missing_sheet_findings")
def missing_sheet_findings(spark, d):
    return A.missing_sheet_findings(_bitext(spark, d)[2])


# --------------------------------------------------------------------------
# 2.3 joins
# --------------------------------------------------------------------------

@q("match_sheets")
def match_sheets(spark, d):
    return _bitext(spark, d)[2]


@q("align_cells")
def align_cells(spark, d):
    return _pairs(spark, d)


@q("classify_pairs")
def classify_pairs(spark, d):
    return _pairs(spark, d).select("workbook_id", "sheet", "coordinate", "match")


@shared
def _compare(spark, d):
    docs = FX.fx_sensitive(spark, d)
    named = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"),
                        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt")
                                 .otherwise(".csv")).alias("path"),
                        "text", (F.col("doc_id") % 2 == 1).alias("is_source"))
    return CMP.compare_sections(corpus_counts(named), FX.doc_roles(FX.documents(spark, d).select("doc_id")))


@q("compare_sections")
def compare_sections(spark, d):
    return _compare(spark, d)


@q("missing_sheets")
def missing_sheets(spark, d):
    return A.missing_sheets(_bitext(spark, d)[2]).select("workbook_id", "sheet", "sheet_idx")


# --------------------------------------------------------------------------
# 2.4 aggregations
# --------------------------------------------------------------------------

@q("match_stats")
def match_stats(spark, d):
    return A.match_stats(_pairs(spark, d))


@q("consistency_issues")
def consistency_issues(spark, d):
    i = A.consistency_issues(_pairs(spark, d))
    return i.select("workbook_id", "source", "occurrences", "n_translations",
                    F.array_join("translations", " | ").alias("translations"), "first_seq")


@q("issue_translations")
def issue_translations(spark, d):
    return A.issue_translations(_pairs(spark, d))


@q("issue_occurrences")
def issue_occurrences(spark, d):
    return A.issue_occurrences(_pairs(spark, d))


@q("consistency_findings")
def consistency_findings(spark, d):
    return A.consistency_findings(_pairs(spark, d))


@q("consistency_totals")
def consistency_totals(spark, d):
    return A.consistency_totals(_pairs(spark, d), FX.workbooks(spark, d))


@q("review_texts")
def review_texts(spark, d):
    return S.document_texts(FX.documents(spark, d), G.line_segments("text"))


@q("review_texts_cells")
def review_texts_cells(spark, d):
    """Flat segments: the cells of a workbook, whose texts repeat."""
    return S.review_texts(G.segment_cells(FX.fx_tgt(spark, d), admit="nonnull"))


@q("review_texts_corpus")
def review_texts_corpus(spark, d):
    return S.review_texts(FX.fx_lines(spark, d), per_document=False)


@q("segment_totals")
def segment_totals(spark, d):
    """Every document of the markdown corpus, those that an unclosed fence
    leaves without segments included."""
    docs = FX.fx_markdown(spark, d)
    return S.document_counts(docs, G.markdown_segments("text"), "basic5", may_hold=K.may_hold_findings("text", "basic5"))


@q("segment_totals_sensitive")
def segment_totals_sensitive(spark, d):
    return S.document_counts(FX.fx_sensitive(spark, d), G.line_segments("text"), "basic5",
                             may_hold=K.may_hold_findings("text", "basic5"))


@q("sheet_alignment")
def sheet_alignment(spark, d):
    _, _, sm, pairs = _bitext(spark, d)
    return A.sheet_alignment(pairs, sm)


@q("pair_totals")
def pair_totals(spark, d):
    _, _, sm, pairs = _bitext(spark, d)
    return A.pair_totals(pairs, bitext_findings(pairs, sm), FX.workbooks(spark, d))


@q("size_ratio")
def size_ratio(spark, d):
    return CMP.size_ratio(_compare(spark, d))


@q("sheet_summary")
def sheet_summary(spark, d):
    return S.sheet_summary(G.scan_cells(FX.fx_conv_cells(spark, d)), FX.conv_sheets(spark, d))


@q("workbook_summary")
def workbook_summary(spark, d):
    return S.workbook_summary(FX.conv_sheets(spark, d))


@q("cells_by_language")
def cells_by_language(spark, d):
    return S.cells_by_language(G.scan_cells(FX.fx_conv_cells(spark, d)))


@q("findings_by_dimension")
def findings_by_dimension(spark, d):
    return S.findings_by_dimension(_report_findings(spark, d))


@q("findings_grouped")
def findings_grouped(spark, d):
    return S.findings_grouped(_report_findings(spark, d))


@q("report_summary")
def report_summary(spark, d):
    return R.report_summary(_report_findings(spark, d), "core10")


@q("report_summary_all12")
def report_summary_all12(spark, d):
    return R.report_summary(_report_findings(spark, d), "all12")


@q("report_grand_total")
def report_grand_total(spark, d):
    s = R.report_summary(_report_findings(spark, d), "all12")
    return s.filter(F.col("dimension") == C.GRAND_TOTAL_LABEL)


@q("report_assessment")
def report_assessment(spark, d):
    s = R.report_summary(_report_findings(spark, d), "core10")
    return R.report_assessment(s, "Automated pass only; manual dimensions pending review.")


# --------------------------------------------------------------------------
# 2.5 windows, sorts, limits
# --------------------------------------------------------------------------

@q("fence_parity")
def fence_parity(spark, d):
    return G.fence_parity(FX.fx_markdown(spark, d))


@q("first_locations")
def first_locations(spark, d):
    return S.document_first_locations(FX.documents(spark, d), G.line_segments("text"))


@q("first_locations_cells")
def first_locations_cells(spark, d):
    return S.first_locations(G.segment_cells(FX.fx_tgt(spark, d), admit="nonnull"))


@q("first_coordinates")
def first_coordinates(spark, d):
    return A.first_coordinates(_pairs(spark, d))


@q("sample_texts")
def sample_texts(spark, d):
    return S.sample_texts(G.scan_cells(FX.fx_conv_cells(spark, d)))


@q("cap_sections")
def cap_sections(spark, d):
    return CMP.cap_sections(FX.fx_lines(spark, d))


@q("cap_sections_cells")
def cap_sections_cells(spark, d):
    """A workbook with more segments than the cap."""
    return CMP.cap_sections(G.segment_cells(FX.fx_tgt(spark, d), admit="nonnull")).select(
        "doc_id", "seq", "location", "text", "rn")


@q("sheet_position")
def sheet_position(spark, d):
    return A.sheet_position(FX.tgt_sheet_names(spark, d))


@q("match_sheets_listed")
def match_sheets_listed(spark, d):
    """Sheets matched from sheet lists that hold sheets without cells."""
    src, tgt = FX.listed_sheets(spark, d)
    return A.match_sheets(src, tgt)


@q("pick_first_target")
def pick_first_target(spark, d):
    return _bitext(spark, d)[2].filter(F.col("target_sheet").isNotNull())


@q("sort_column_major")
def sort_column_major(spark, d):
    p = _pairs(spark, d).select("workbook_id", "sheet", "coordinate", "pair_seq")
    return number_rows(p, ["workbook_id", "pair_seq"], "rn")


@q("sort_row_major")
def sort_row_major(spark, d):
    cells = FX.fx_src(spark, d).select(
        "workbook_id", "sheet", X.a1_coordinate("col_no", "row_no").alias("coordinate"),
        G.cell_seq("sheet_idx", "row_no", "col_no").alias("cell_seq"))
    return number_rows(cells, ["workbook_id", "cell_seq"], "rn")


@q("sort_by_frequency")
def sort_by_frequency(spark, d):
    t = S.review_texts(FX.fx_lines(spark, d), per_document=False)
    return number_rows(t, [-F.col("occurrence_count"), "first_doc", "first_seq"], "rn")


@q("number_findings")
def number_findings(spark, d):
    f = _report_findings(spark, d)
    return number_rows(f, [c for c in R.ORDER_COLS if c in f.columns], "n").select("n", "stream", "doc_id", "location",
                                                    "dimension")


# --------------------------------------------------------------------------
# 2.6 set operations
# --------------------------------------------------------------------------

@q("coord_union")
def coord_union(spark, d):
    src, tgt, sm, _ = _bitext(spark, d)
    return A.coord_union(src, tgt, sm)


@q("merge_findings")
def merge_findings(spark, d):
    return _report_findings(spark, d)


@q("merge_pairs")
def merge_pairs(spark, d):
    return _pairs(spark, d).select("workbook_id", "sheet", "target_sheet", "coordinate",
                                   "source", "target")


@q("distinct_translations")
def distinct_translations(spark, d):
    return A.distinct_translations(_pairs(spark, d))


# --------------------------------------------------------------------------
# 2.7 scalar functions
# --------------------------------------------------------------------------

@q("py_strip")
def py_strip(spark, d):
    c = FX.conversations(spark, d)
    return c.select("conv_id", "turn", X.py_strip("text").alias("stripped"))


@q("detect_language")
def detect_language(spark, d):
    return FX.documents(spark, d).select("doc_id", "lang",
                                         X.detect_language("text").alias("detected"))


@q("detect_language_table")
def detect_language_table(spark, d):
    """Rules as a table: the languages of ``documents`` by their rank, each known by
    its first two letters' classes."""
    docs = FX.documents(spark, d)
    langs = docs.groupBy("lang").count().where("lang is not null")
    rules = langs.select((-F.col("count")).alias("ord"), F.upper("lang").alias("lang"),
                         F.concat(F.lit("(?i)["), "lang", F.lit("]{2}")).alias("pattern"))
    return docs.select("doc_id", X.detect_language("text", rules).alias("detected"))


@q("run_counts")
def run_counts(spark, d):
    """The counts of a written report, from the job that wrote it, beside its summary."""
    path = _io_dir(spark, "counts")
    status = R.write_report(R.merge_findings(_report_findings(spark, d), _manual_findings(spark, d)), path)
    counts = spark.createDataFrame([(k, status[f"{k}_count"]) for k in ("findings", "rejects", "unlisted")], "name string, n bigint")
    summary = spark.read.parquet(f"{path}/{C.SUMMARY_SHEET}")
    return counts.unionByName(summary.select(F.col(C.SUMMARY_HEADINGS["dimension"]).alias("name"), F.col(C.SUMMARY_HEADINGS["total"]).alias("n")))


@q("lang_name")
def lang_name(spark, d):
    return FX.documents(spark, d).select(
        "doc_id", X.lang_name(X.detect_language("text")).alias("language"))


@q("count_matches")
def count_matches(spark, d):
    docs = FX.documents(spark, d)
    return docs.select("doc_id", *[X.count_matches("text", p).alias(f"n_{lang.lower()}")
                                   for lang, p in C.LANG_PATTERNS])


@q("find_terms")
def find_terms(spark, d):
    docs = FX.fx_sensitive(spark, d)
    pat = K.rule_pattern(C.RULES_EXTENDED7[4][1])
    return docs.select("doc_id", F.array_join(X.find_terms("text", pat), ",").alias("terms"))


@q("parse_coordinate")
def parse_coordinate(spark, d):
    p = read_table(spark, d, "part")
    coord = X.a1_coordinate((F.col("p_partkey") % 16384) + 1, F.col("p_size"))
    return p.select("p_partkey", coord.alias("coordinate"),
                    X.parse_coordinate(coord).alias("pc")).select(
        "p_partkey", "coordinate", F.col("pc.col_no").alias("col_no"),
        F.col("pc.row_no").alias("row_no"))


@q("a1_coordinate")
def a1_coordinate(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", X.a1_coordinate((F.col("p_partkey") % 16384) + 1,
                                                 F.col("p_size")).alias("coordinate"))


@q("location_string")
def location_string(spark, d):
    p = read_table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(
        "p_partkey",
        X.loc_cell("p_brand", X.a1_coordinate(s, k + 1)).alias("cell"),
        X.loc_line(k + 1).alias("line"),
        X.loc_paragraph(k + 1, F.when(k % 3 == 0, "Normal").when(k % 3 == 1, "Heading 1"))
        .alias("paragraph"),
        X.loc_table(s, k + 1, F.lit(2)).alias("doc_table"),
        X.loc_slide_paragraph(s, k + 1).alias("slide"),
        X.loc_slide_table(s, k + 1, F.lit(1)).alias("slide_table"),
        X.loc_page_line(s, k + 1).alias("page_line"),
        X.loc_page_table(s, k + 1, F.lit(3)).alias("page_table"),
        X.loc_html(F.lit("p"), "p_name").alias("html"),
        X.loc_sheet("p_brand").alias("sheet"))


@q("truncate_text")
def truncate_text(spark, d):
    docs = FX.documents(spark, d)
    return docs.select("doc_id", *[X.truncate_text("text", n).alias(f"t{n}")
                                   for n in (C.CUT_CONSISTENCY, C.CUT_HTML_LOCATION,
                                             C.CUT_PAIR, C.CUT_FINDING)])


@q("char_count")
def char_count(spark, d):
    return FX.documents(spark, d).select("doc_id", X.char_count("text").alias("char_count"))


@q("strip_sheet_suffix")
def strip_sheet_suffix(spark, d):
    s = A.sheets_of(FX.fx_tgt(spark, d))
    return s.select("sheet", X.strip_sheet_suffix("sheet").alias("base"))


@q("starts_with")
def starts_with(spark, d):
    """Whether each source sheet's chosen target starts with its name."""
    m = _bitext(spark, d)[2].filter(F.col("target_sheet").isNotNull())
    return m.select(F.col("sheet").alias("source_sheet"), "target_sheet",
                    F.col("target_sheet").startswith(F.col("sheet")).alias("starts_with"))


@q("file_suffix")
def file_suffix(spark, d):
    r = FX.fx_routed(spark, d)
    return r.select("doc_id", "path", X.file_suffix("path").alias("suffix"))


@q("compare_mode")
def compare_mode(spark, d):
    r = FX.fx_routed(spark, d)
    return r.select("doc_id", X.compare_mode("path").alias("mode"))


@q("format_ratio")
def format_ratio(spark, d):
    c = CMP.size_ratio(_compare(spark, d), with_message=False)
    return c.select("pair_id", X.format_ratio("ratio").alias("ratio_text"))


@q("list_repr")
def list_repr(spark, d):
    """Lists as Python prints them: as they are, with single quotes and
    backslashes, and with both kinds of quotes and a line end."""
    s = A.consistency_issues(_pairs(spark, d))
    t = F.col("translations")
    return s.select(
        "source", X.list_repr(t).alias("repr"),
        X.list_repr(F.transform(t, lambda x: F.concat(F.lit("l'"), x, F.lit("\\")))).alias("quoted"),
        X.list_repr(F.transform(t, lambda x: F.concat(F.lit("l'\""), x, F.lit("\n\u00a0")))).alias("both"),
        X.list_repr(F.array().cast("array<string>")).alias("none"))


@q("html_text")
def html_text(spark, d):
    p = FX.pages(spark, d)
    return p.select("page_id", G.html_text(F.col("html")).alias("text"))


@q("severity_style")
def severity_style(spark, d):
    f = R.with_defaults(_report_findings(spark, d))
    sev = F.broadcast(R.severities_table(spark).select("severity", "fill_rgb"))
    return f.join(sev, "severity", "left").select("stream", "doc_id", "phase", "seq", "sub",
                                                  "severity", "fill_rgb")


@q("finding_json")
def finding_json(spark, d):
    f = _report_findings(spark, d)
    return f.select("stream", "doc_id", "phase", "seq", "sub",
                    F.to_json(F.struct("dimension", "severity", "location", "description"))
                    .alias("json"))


# --------------------------------------------------------------------------
# 2.10 rule packs for the documented checks
# --------------------------------------------------------------------------

@q("fullwidth_punct")
def fullwidth_punct(spark, d):
    return RP.fullwidth_punct_findings(FX.fx_fullwidth_lines(spark, d))


@q("register_mix")
def register_mix(spark, d):
    return RP.register_mix_findings(FX.fx_register(spark, d), lang_col="lang")


@q("register_mix_any")
def register_mix_any(spark, d):
    """Every language's forms in every document."""
    return RP.register_mix_findings(FX.fx_register(spark, d), lang_col=None)


@q("register_mix_jako")
def register_mix_jako(spark, d):
    return RP.register_mix_jako(FX.fx_jako(spark, d))


@q("register_mix_jako_findings")
def register_mix_jako_findings(spark, d):
    return RP.register_mix_jako_findings(FX.fx_jako(spark, d))


@q("terminology_check")
def terminology_check(spark, d):
    f = RP.terminology_findings(_pairs(spark, d), FX.fx_glossary(spark, d))
    return f.drop("sub")


@q("terminology_check_large")
def terminology_check_large(spark, d):
    """The way of glossaries too large to be tested inside the row."""
    f = RP.terminology_findings(_pairs(spark, d), FX.fx_glossary(spark, d), inline_terms=0)
    return f.drop("sub")


@q("ingest_manual")
def ingest_manual(spark, d):
    """Reader findings (from ``labels``) written as JSON lines, read back and
    appended to the automated ones."""
    path = _io_dir(spark, "manual")
    R.write_review(_manual_findings(spark, d).select("dimension", "severity", "location",
                                                     "description"), path, fmt="json")
    manual, _ = R.read_findings(spark, path, multi_line=False)
    merged = R.ingest_manual(_bitext_findings(spark, d).select(
        "dimension", "severity", "location", "description"), manual)
    return merged.select("stream", "dimension", "severity", "location", "description")


@q("report_with_manual")
def report_with_manual(spark, d):
    merged = R.merge_findings(_report_findings(spark, d), _manual_findings(spark, d))
    return R.report_summary(merged, "core10")


@q("markdown_summary")
def markdown_summary(spark, d):
    return R.markdown_summary(R.report_summary(_report_findings(spark, d), "all12"))
