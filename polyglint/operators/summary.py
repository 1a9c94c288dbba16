"""Review summaries: unique texts, per-document totals, sheet summaries,
samples and finding counts.

Documents are counted and deduplicated inside the row, without a shuffle.  Of
flat tables, top-k lists use ``row_number() <= k`` (a partial WindowGroupLimit
below the shuffle); counts use map-side-combined aggregates.  Nothing collects an
unbounded group: the only ``collect_list`` calls run over lists already cut
to k rows, over the languages of a sheet, or over the sheets of a workbook.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import let
from ..sources.segmenters import SEGMENTS
from .checks import finding_hits, resolve_pack


def _ordered_join(values_with_order, sep: str):
    """``array_join`` of ``x.v`` after sorting ``struct(o, v)`` entries."""
    return F.array_join(F.transform(F.array_sort(values_with_order), lambda x: x["v"]), sep)


def unique_texts(segments, k: int = C.CAP_LOCATIONS):
    """The different texts of an in-row segment array: array of (text,
    occurrence_count, first_seq, firsts), the last being the (seq, location) of
    the first ``k`` places.

    Segments are sorted by text and place; a run of equal texts is one entry,
    which knows its places from the run's beginning and the next one's."""
    def places(sorted_):
        begins = F.filter(F.transform(sorted_, lambda x, i: F.when(
            (i == 0) | (F.try_element_at(sorted_, F.greatest(i, F.lit(1)))["text"] != x["text"]), i)), lambda i: i.isNotNull())

        def runs(starts):
            def entry(start, r):
                n = F.coalesce(F.try_element_at(starts, r + 2), F.size(sorted_)) - start
                first = F.element_at(sorted_, start + 1)
                return F.struct(first["text"].alias("text"), n.cast("bigint").alias("occurrence_count"), first["seq"].alias("first_seq"),
                                F.transform(F.slice(sorted_, start + 1, F.least(n, F.lit(k))),
                                            lambda x: F.struct(x["seq"].alias("seq"), x["location"].alias("location"))).alias("firsts"))
            return F.transform(starts, entry)

        return let(begins, runs)

    ordered = F.array_sort(F.transform(segments, lambda s: F.struct(
        s["text"].alias("text"), s["seq"].alias("seq"), s["location"].alias("location"))))
    return let(ordered, places)


def _document_texts(docs: DataFrame, segments, k: int, id_col: str) -> DataFrame:
    none = F.array().cast(SEGMENTS)
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(unique_texts(F.coalesce(segments, none), k)))


def document_texts(docs: DataFrame, segments, k: int = C.CAP_LOCATIONS, sep: str = "; ", id_col: str = "doc_id") -> DataFrame:
    """``review_texts`` of documents whose segments are an in-row array
    (``segmenters.line_segments`` ...): one scan, no shuffle."""
    u = _document_texts(docs, segments, k, id_col)
    return u.select("doc_id", "text", F.array_join(F.transform("firsts", lambda x: x["location"]), sep).alias("locations"),
                    "occurrence_count", "first_seq")


def document_first_locations(docs: DataFrame, segments, k: int = C.CAP_LOCATIONS, id_col: str = "doc_id") -> DataFrame:
    """``first_locations`` of documents: one scan, no shuffle."""
    u = _document_texts(docs, segments, k, id_col).select("doc_id", "text", F.posexplode("firsts").alias("pos", "f"))
    return u.select("doc_id", "text", "f.seq", "f.location", (F.col("pos") + 1).cast("bigint").alias("rn"))


def review_texts(segments: DataFrame, k: int = C.CAP_LOCATIONS, per_document: bool = True,
                 sep: str = "; ") -> DataFrame:
    """Deduplicated texts for the human reader, of flat segments (cells, slides;
    documents have ``document_texts``).

    One row per (document, text) — or per text across the corpus when
    ``per_document`` is false — with ``occurrence_count``, the first
    ``k`` locations (document order) joined with ``sep``, and ``first_seq``.
    Order the output by ``occurrence_count desc, first_seq`` to get the
    reading order (a range-partitioned sort, no global window).

    Texts are told apart by a digest.  Counts are shuffled as digests, with
    map-side combine; texts once, in at most ``k`` rows of a map task (partial
    WindowGroupLimit), to the same partitions.
    """
    keys = ["doc_id", "_digest"] if per_document else ["_digest"]
    loc = F.col("location") if per_document else F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("location"))
    okeys = ["_o0"] if per_document else ["_o0", "_o1"]
    order = [F.col("seq")] if per_document else [F.col("doc_id"), F.col("seq")]
    segs = segments.withColumn("_digest", F.md5(F.col("text").cast("binary")))
    counts = segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"))
    w = Window.partitionBy(*keys).orderBy(*okeys)
    top = (segs.select(*keys, "text", *[o.alias(n) for n, o in zip(okeys, order)], loc.alias("_loc"))
           .withColumn("_rn", F.row_number().over(w))
           .filter(F.col("_rn") <= k))
    firsts = F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("o"), F.col("_loc").alias("v"),
                                                  *[F.col(n) for n in okeys])))
    locs = top.groupBy(*keys).agg(F.first("text").alias("text"), firsts.alias("_f"))
    out = counts.join(locs, keys)
    cols = (["doc_id"] if per_document else []) + ["text", F.array_join(F.transform("_f", lambda x: x["v"]), sep).alias("locations"),
                                                   F.col("occurrence_count").cast("bigint").alias("occurrence_count")]
    if per_document:
        cols.append(F.col("_f")[0]["_o0"].alias("first_seq"))
    else:
        cols += [F.col("_f")[0]["_o0"].alias("first_doc"), F.col("_f")[0]["_o1"].alias("first_seq")]
    return out.select(*cols)


def first_locations(segments: DataFrame, k: int = C.CAP_LOCATIONS) -> DataFrame:
    """The first ``k`` segments (document order) of every (document, text)."""
    w = Window.partitionBy("doc_id", "text").orderBy("seq")
    return (segments.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select("doc_id", "text", "seq", "location", F.col("rn").cast("bigint").alias("rn")))


def document_counts(docs: DataFrame, segments, pack="basic5", id_col: str = "doc_id",
                    is_source=None, may_hold=None) -> DataFrame:
    """(doc_id, total_sections, unique_texts, automated_count) of every
    document, those without segments included: counted inside the row, in one
    scan and without a shuffle.

    ``segments`` is an in-row segment array (``segmenters.line_segments`` ...);
    documents for which the column ``is_source`` holds get no findings, and
    neither do those for which ``may_hold`` does not (``checks.
    may_hold_findings``; their segments are not looked at)."""
    def counts(segs):
        found = F.aggregate(segs, F.lit(0).cast("bigint"),
                            lambda n, s: n + F.size(finding_hits(s["text"], pack)))
        if may_hold is not None:
            found = F.when(F.coalesce(may_hold, F.lit(False)), found).otherwise(F.lit(0).cast("bigint"))
        if is_source is not None:
            found = F.when(F.coalesce(is_source, F.lit(False)), F.lit(0).cast("bigint")).otherwise(found)
        return F.struct(F.size(segs).cast("bigint").alias("total_sections"),
                        F.size(F.array_distinct(F.transform(segs, lambda s: s["text"]))).cast("bigint").alias("unique_texts"),
                        found.alias("automated_count"))

    pack = resolve_pack(pack)
    none = F.array().cast(SEGMENTS)
    # inline: the counts of a row are one value, which no later projection works out again
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(let(F.coalesce(segments, none), counts))))


# --------------------------------------------------------------------------
# workbook scan summaries (over scan_cells output)
# --------------------------------------------------------------------------

def cells_by_language(scanned: DataFrame) -> DataFrame:
    """(workbook, sheet, lang) with cell count and first cell position."""
    return scanned.groupBy("workbook_id", "sheet", "sheet_idx", "lang").agg(
        F.count(F.lit(1)).alias("cells"), F.min("cell_seq").alias("first_seq"))


def sheet_summary(scanned: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Per sheet: total cells and its languages in first-seen order.  With
    ``sheets`` (workbook_id, sheet, sheet_idx) a sheet without string cells has
    a row too: no cells, no languages."""
    if sheets is not None:
        known = sheet_summary(scanned).select("workbook_id", "sheet", "total_cells", "languages")
        return sheets.select("workbook_id", "sheet", "sheet_idx").distinct().join(
            known, ["workbook_id", "sheet"], "left").select(
                "workbook_id", "sheet", "sheet_idx", F.coalesce("total_cells", F.lit(0)).cast("bigint").alias("total_cells"),
                F.coalesce("languages", F.lit("")).alias("languages"))
    by_lang = cells_by_language(scanned)
    return by_lang.groupBy("workbook_id", "sheet", "sheet_idx").agg(
        F.sum("cells").cast("bigint").alias("total_cells"),
        _ordered_join(F.collect_list(F.struct(F.col("first_seq").alias("o"),
                                              F.col("lang").alias("v"))), ",")
        .alias("languages"))


def sample_texts(scanned: DataFrame, k: int = C.CAP_SAMPLES) -> DataFrame:
    """First ``k`` cells (row-major) per sheet and language."""
    w = Window.partitionBy("workbook_id", "sheet", "lang").orderBy("cell_seq")
    return (scanned.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select("workbook_id", "sheet", "lang", "coordinate", "value",
                    F.col("rn").cast("bigint").alias("rn")))


def workbook_summary(cells: DataFrame) -> DataFrame:
    """Per workbook: sheet count and sheet names in workbook order.  Takes
    cells or, better, the sheet list itself (workbook_id, sheet, sheet_idx),
    which also holds the sheets without cells."""
    sheets = cells.select("workbook_id", "sheet", "sheet_idx").distinct()
    return sheets.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("sheet_count"),
        _ordered_join(F.collect_list(F.struct(F.col("sheet_idx").alias("o"),
                                              F.col("sheet").alias("v"))), ", ")
        .alias("sheet_names"))


# --------------------------------------------------------------------------
# findings
# --------------------------------------------------------------------------

def findings_by_dimension(findings: DataFrame) -> DataFrame:
    return findings.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))


def dimensions_table(spark, dims=C.DIMENSIONS_ALL12) -> DataFrame:
    return spark.createDataFrame([(i, d) for i, d in enumerate(dims)],
                                 "dim_ord bigint, dimension string")


def findings_grouped(findings: DataFrame) -> DataFrame:
    """Findings listed under their dimension: the flat table with the
    dimension's report position (``dim_ord``, NULL for unknown dimensions).
    Sort by (dim_ord, order columns) or write ``partitionBy('dimension')``;
    no dimension is ever gathered into one task."""
    dims = F.broadcast(dimensions_table(findings.sparkSession))
    return findings.join(dims, "dimension", "left")
