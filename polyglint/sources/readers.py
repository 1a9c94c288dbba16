"""Document sources.

Text-like files (txt, csv, md, html ...) are read whole, one row per file,
with the file path from the scan's ``_metadata``; the path then drives
``route_format`` / ``segment_routed``.  Files larger than a row should be are
read line by line in splits (``load_text_lines``).  Tables that already hold documents
are read with ``spark.read.parquet`` (see ``session.read_table``).
Findings written by readers come in through ``operators.report.read_findings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import Window

from ..functions import text as X
from ..operators.report import read_findings  # noqa: F401  (re-exported source)
from ..plans.strategy import BROADCAST_MAX_ROWS
from ..session import spread_scan
from .segmenters import FENCE


def _files(spark: SparkSession, glob: str | None, recursive: bool):
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", True) if recursive else r


def load_text_files(spark: SparkSession, path: str, glob: str | None = None,
                    recursive: bool = True) -> DataFrame:
    """One row per file: ``doc_id`` (the path), ``path``, ``text``.

    ``wholetext`` keeps each file in one row so that line numbers and fences
    are counted over the whole file; many small files are packed into few
    tasks by the file-source planner and spread again when too narrow.
    """
    df = _files(spark, glob, recursive).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"),
                             F.col("value").alias("text"))
    return spread_scan(df.select(F.col("path").alias("doc_id"), "path", "text"))


def load_text_lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True,
                    fences: bool = False) -> DataFrame:
    """The lines of text files of any size: ``doc_id`` (the path), ``line_no``
    (from 1), ``raw``, ``line`` (stripped); with ``fences`` also ``is_fence`` and
    ``in_code``.  Equal to what the whole-file reader gives, whatever the splits,
    but for the empty line that it counts behind a last line end.

    Files are read in splits.  What a line must know of the text before its
    split (lines, and fences, whose parity tells whether it is code) is a sum
    over earlier splits of its file: one row a split, a prefix sum a file.  Line
    numbers need no shuffle of lines; fences move each line once, to its split.
    """
    raw = _files(spark, glob, recursive).text(path).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    lines = raw.withColumn("line", X.py_strip("raw")).withColumn("is_fence", F.col("line").startswith(FENCE))
    before = Window.partitionBy("doc_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    splits = lines.groupBy("doc_id", "_split").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if("is_fence").alias("_f")).select(
            "doc_id", "_split", "_first", prior("_n").alias("_lines"), prior("_f").alias("_fences"))
    # splits are as many as files and full-sized pieces of the input, at most
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    piece = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if len(raw.inputFiles()) + size // piece <= BROADCAST_MAX_ROWS:
        splits = F.broadcast(splits)
    out = lines.join(splits, ["doc_id", "_split"]).withColumn(
        "line_no", F.col("_lines") + F.col("_at") - F.col("_first") + 1)
    if not fences:
        return out.select("doc_id", "line_no", "raw", "line")
    inside = Window.partitionBy("doc_id", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("_fences") + F.coalesce(F.count_if("is_fence").over(inside), F.lit(0))
    return out.select("doc_id", "line_no", "raw", "line", "is_fence", (seen % 2 == 1).alias("in_code"))


def segment_text_lines(lines: DataFrame, min_len: int = 1) -> DataFrame:
    """``segment_lines`` of ``load_text_lines``."""
    return lines.where(F.length("line") > min_len).select(
        "doc_id", F.col("line_no").alias("seq"), X.loc_line("line_no").alias("location"), F.col("line").alias("text"))


def segment_markdown_lines(lines: DataFrame) -> DataFrame:
    """``segment_markdown`` of ``load_text_lines(..., fences=True)``."""
    return segment_text_lines(lines.where(~F.col("is_fence") & ~F.col("in_code") & ~F.col("line").startswith("#")))


def load_parquet_documents(spark: SparkSession, path: str, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """Documents already stored as a table, with the file they came from."""
    df = spark.read.parquet(path).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.col("_metadata.file_path").alias("path"))
    return spread_scan(df)
