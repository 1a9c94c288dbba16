"""Generic (non-workbook) source/target document comparison.

Per document pair: segment counts of both sides, the target's automated
finding count, and a size warning when the target has more than 1.5x or
fewer than 0.5x the source's segments.  Documents are counted inside the
row, so that the join with the pairing only sees one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import text as X


def compare_sections(counts: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per pair: ``pair_id, source_doc, target_doc, source_ok,
    target_ok, source_format, target_format, source_count, target_count,
    automated_count``.

    ``counts`` is one row per document (doc_id, total_sections,
    automated_count and, where known, format; see ``summary.document_counts``);
    ``roles`` is (pair_id, role in {source, target}, doc_id).  Ids may be of
    any type.  A side whose document has no row failed to extract: it counts 0
    and its format is ``unknown``.  One join of one row per document and one
    aggregation: no segment is shuffled.
    """
    if "format" not in counts.columns:
        counts = counts.withColumn("format", F.lit(None).cast("string"))
    per_doc = roles.select("pair_id", "role", "doc_id").join(
        counts.select("doc_id", "format", "total_sections", "automated_count", F.lit(True).alias("ok")), "doc_id", "left")
    side = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return per_doc.groupBy("pair_id").agg(
        side("source", "doc_id").alias("source_doc"), side("target", "doc_id").alias("target_doc"),
        F.coalesce(side("source", "ok"), F.lit(False)).alias("source_ok"),
        F.coalesce(side("target", "ok"), F.lit(False)).alias("target_ok"),
        F.coalesce(side("source", "format"), F.lit("unknown")).alias("source_format"),
        F.coalesce(side("target", "format"), F.lit("unknown")).alias("target_format"),
        zero(side("source", "total_sections")).alias("source_count"),
        zero(side("target", "total_sections")).alias("target_count"),
        zero(side("target", "automated_count")).alias("automated_count"))


def size_ratio(cmp: DataFrame, with_message: bool = True) -> DataFrame:
    """Add ``ratio = target / max(source, 1)``, ``size_flag`` (larger when
    ratio > 1.5, smaller when < 0.5, strict) and the warning text; nothing
    when either side failed."""
    both = F.col("source_ok") & F.col("target_ok")
    ratio = F.when(both, F.col("target_count").cast("double")
                   / F.greatest(F.col("source_count"), F.lit(1)).cast("double"))
    out = cmp.withColumn("ratio", ratio).withColumn(
        "size_flag",
        F.when(F.col("ratio") > C.RATIO_LARGER, "larger")
        .when(F.col("ratio") < C.RATIO_SMALLER, "smaller"))
    if with_message:
        r = X.format_ratio("ratio")
        msg = (F.when(F.col("size_flag") == "larger", X.render(C.MESSAGES["larger"], ratio=r))
               .when(F.col("size_flag") == "smaller", X.render(C.MESSAGES["smaller"], ratio=r)))
        out = out.withColumn("size_warning", msg)
    return out


def cap_sections(segments: DataFrame, k: int = C.CAP_SECTIONS) -> DataFrame:
    """First ``k`` segments of every document, with their rank ``rn``.
    ``row_number() <= k`` plans as a partial WindowGroupLimit before the
    shuffle, so at most k rows per document leave each map task."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return (segments.withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= k).withColumn("rn", F.col("rn").cast("bigint")))
