"""The three review jobs: documents, bilingual workbooks, and the report.

Each returns a dict of lazily planned DataFrames.  Inputs that feed several
outputs (the sheet map, the aligned pairs) are persisted; persisting keeps
the lineage, so a lost executor only recomputes its partitions.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import checks as K
from ..operators import compare as CMP
from ..operators import report as R
from ..operators import summary as S
from ..sources import segmenters as G
from ..session import cut_lineage
from .strategy import checked_broadcast

SEGMENTERS = {
    "txt": G.segment_lines,
    "md": G.segment_markdown,
    "html": lambda d: G.segment_html(d, "doc_id", "text"),
}
ARRAYS = {"txt": G.line_segments, "md": G.markdown_segments, "html": G.html_segments}


def review_documents(docs: DataFrame, fmt: str = "txt", pack: str = "basic5",
                     is_source: bool = False, findings_only: bool = False) -> dict[str, DataFrame]:
    """Segment documents (``doc_id, text``), check target segments, and
    prepare the deduplicated reading list.  Totals hold every document.  With
    ``findings_only`` (plain text / markdown) only documents that can hold a
    finding are segmented."""
    if findings_only and fmt in ("txt", "md"):
        return {"findings": K.document_findings(docs.select("doc_id", "text"),
                                                SEGMENTERS[fmt], pack)}
    segs = SEGMENTERS[fmt](docs.select("doc_id", "text"))
    totals = S.document_counts(docs, ARRAYS[fmt]("text"), pack, is_source=F.lit(is_source),
                               may_hold=None if fmt == "html" else K.may_hold_findings("text", pack))
    if is_source:
        return {"segments": segs, "findings": K.automated_findings(segs.limit(0), pack), "totals": totals}
    return {
        "segments": segs,
        "findings": K.automated_findings(segs, pack),
        "review_texts": S.document_texts(docs, ARRAYS[fmt]("text")),
        "totals": totals,
    }


def review_corpus(docs: DataFrame, pack: str = "basic5") -> dict[str, DataFrame]:
    """Review a mixed corpus (``doc_id, path, text``; e.g. from
    ``sources.readers.load_text_files``): route each document by its suffix
    (markdown, HTML, plain text), segment, check, deduplicate and count.
    Where there is a column ``is_source``, source documents are segmented and
    counted but not checked.  Documents that come as decoded tables instead
    are listed under ``unsegmented``."""
    segs = G.segment_routed(docs)
    targets = docs
    if "is_source" in docs.columns:
        targets = docs.where(~F.coalesce(F.col("is_source"), F.lit(False)))
    checked = G.segment_routed(targets)
    return {
        "segments": segs,
        "findings": K.automated_findings(checked, pack),
        "review_texts": S.document_texts(G.route_format(targets), G.routed_segments("text")),
        "totals": corpus_counts(docs, pack),
        "unsegmented": G.unsegmented(docs),
    }


def corpus_counts(docs: DataFrame, pack: str = "basic5") -> DataFrame:
    """(doc_id, format, total_sections, unique_texts, automated_count) of every
    document of a mixed corpus, in one scan."""
    gate = F.col("is_source") if "is_source" in docs.columns else F.lit(False)
    routed = G.route_format(docs.select("doc_id", "path", "text", gate.alias("is_source")))
    counts = S.document_counts(routed.withColumn("doc_id", F.struct("doc_id", "format")), G.routed_segments("text"), pack,
                               is_source=F.col("is_source"),
                               may_hold=(F.col("parser") == "html") | K.may_hold_findings("text", pack))
    return counts.select("doc_id.doc_id", "doc_id.format", "total_sections", "unique_texts", "automated_count")


def bitext_findings(pairs: DataFrame, sheet_map: DataFrame,
                    qualified_location: bool = False) -> DataFrame:
    """Missing sheets, omissions and additions (phase 0, sheet then
    column-major order), then consistency issues (phase 1)."""
    return (A.missing_sheet_findings(sheet_map)
            .unionByName(A.omission_findings(pairs))
            .unionByName(A.addition_findings(pairs))
            .unionByName(A.consistency_findings(pairs, qualified_location)))


def align_bitext(src_cells: DataFrame, tgt_cells: DataFrame, persist: bool = True,
                 materialize: str = "persist", src_sheets: DataFrame | None = None,
                 tgt_sheets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sheet_map, pairs).  Both feed several outputs, so they are kept:
    ``materialize="persist"`` caches the pairs (memory and disk; a lost
    executor recomputes its part through the join), ``"checkpoint"`` writes
    them to the shared checkpoint folder and cuts the lineage — the choice
    for very large workbooks.  The sheet map is small: it is persisted and
    broadcast into the cell joins behind a row-count check.

    ``src_sheets`` and ``tgt_sheets`` (workbook_id, sheet, sheet_idx) list the
    sheets, those without cells included; without them only sheets with cells
    are known."""
    sheet_map = A.match_sheets(A.sheets_of(src_cells) if src_sheets is None else src_sheets,
                               A.sheets_of(tgt_cells) if tgt_sheets is None else tgt_sheets)
    if persist:
        sheet_map = sheet_map.persist(StorageLevel.MEMORY_AND_DISK)
        sm_join = checked_broadcast(sheet_map)
    else:
        sm_join = sheet_map
    pairs = A.align_cells(src_cells, tgt_cells, sm_join)
    if persist:
        pairs = (cut_lineage(pairs) if materialize == "checkpoint"
                 else pairs.persist(StorageLevel.MEMORY_AND_DISK))
    return sheet_map, pairs


def review_bitext(src_cells: DataFrame, tgt_cells: DataFrame, *, persist: bool = True,
                  with_target_checks: bool = False, pack: str = "basic5",
                  qualified_location: bool = False,
                  report_unmatched_targets: bool = False,
                  materialize: str = "persist", src_sheets: DataFrame | None = None,
                  tgt_sheets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Align a source and a target workbook cell by cell and derive findings,
    statistics and consistency issues.

    Options: ``with_target_checks`` also runs the residual / sensitive checks
    on the target cells; ``qualified_location`` writes consistency
    coordinates as ``Sheet!A1``; ``report_unmatched_targets`` reports cells
    of target sheets no source sheet picked as additions; ``src_sheets`` and
    ``tgt_sheets`` list all sheets (see ``align_bitext``)."""
    sheet_map, pairs = align_bitext(src_cells, tgt_cells, persist, materialize, src_sheets, tgt_sheets)
    findings = bitext_findings(pairs, sheet_map, qualified_location)
    if report_unmatched_targets:
        findings = findings.unionByName(A.unpicked_target_findings(tgt_cells, sheet_map))
    if with_target_checks:
        segs = G.segment_cells(tgt_cells, admit="nonnull")
        findings = findings.unionByName(K.automated_findings(segs, pack))
    return {
        "sheet_map": sheet_map,
        "pairs": pairs,
        "findings": findings,
        "stats": A.match_stats(pairs),
        "sheets": A.sheet_alignment(pairs, sheet_map),
        "consistency": A.consistency_issues(pairs),
        "consistency_translations": A.issue_translations(pairs),
        "consistency_occurrences": A.issue_occurrences(pairs),
        "consistency_totals": A.consistency_totals(pairs, sheet_map),
        "totals": A.pair_totals(pairs, findings, sheet_map),
    }


def compare_documents(docs: DataFrame, roles: DataFrame, pack: str = "basic5",
                      cap: int | None = 200) -> dict[str, DataFrame]:
    """Generic compare of document pairs.  ``docs`` is (doc_id, path, text),
    routed by suffix; ``roles`` is (pair_id, role in {source, target}, doc_id).
    Ids may be of any type, such as the paths that our reader gives.

    A document that is a target of any pair is checked.  ``sections`` holds
    the first ``cap`` segments of every document, all of them without a cap."""
    targets = roles.where("role = 'target'").select("doc_id").distinct().withColumn("_target", F.lit(True))
    docs = docs.select("doc_id", "path", "text").join(targets, "doc_id", "left").select(
        "doc_id", "path", "text", F.col("_target").isNull().alias("is_source"))
    segs = G.segment_routed(docs)
    tgt_segs = G.segment_routed(docs.where(~F.col("is_source")))
    return {
        "compare": CMP.size_ratio(CMP.compare_sections(corpus_counts(docs, pack), roles)),
        "findings": K.automated_findings(tgt_segs, pack),
        "review_texts": S.document_texts(G.route_format(docs.where(~F.col("is_source"))), G.routed_segments("text")),
        "sections": segs if cap is None else CMP.cap_sections(segs, cap),
    }


def scan_workbook(cells: DataFrame, pack: str = "extended7",
                  sheets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scan the cells of workbooks.  ``sheets`` (workbook_id, sheet, sheet_idx)
    lists all sheets; without it those that have any cell are known."""
    sheets = A.sheets_of(cells) if sheets is None else sheets
    scanned = G.scan_cells(cells)
    findings = K.scan_findings(scanned, pack)
    return {
        "cells": scanned,
        "findings": findings,
        "sheets": S.sheet_summary(scanned, sheets),
        "samples": S.sample_texts(scanned),
        "workbook": S.workbook_summary(sheets),
        "by_dimension": S.findings_by_dimension(findings),
        "by_language": S.cells_by_language(scanned),
    }


def build_report(findings: DataFrame, dims="core10") -> dict[str, DataFrame]:
    return {
        "detail": R.report_detail(findings),
        "summary": R.report_summary(findings, dims),
        "rejects": R.report_rejects(findings, dims),
    }
