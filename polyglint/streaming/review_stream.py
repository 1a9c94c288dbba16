"""Structured Streaming review of incoming documents.

The segmenters and the residual / sensitive checks are narrow
transformations (no shuffle, no window, no state), so the batch functions
apply unchanged to a streaming DataFrame: every micro-batch of new
documents is segmented and checked, and its findings are appended to the
sink.  Exactly-once output comes from the sink's checkpoint; the
checkpoint location must be a shared folder on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.checks import automated_findings, document_findings
from ..operators.report import report_metrics
from ..sources.segmenters import segment_html, segment_lines, segment_markdown

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

METRICS = "review"          # name of the observed metrics of a review stream

SEGMENTERS = {
    "txt": lambda df: segment_lines(df),
    "md": lambda df: segment_markdown(df),
    "html": lambda df: segment_html(df, "doc_id", "text"),
}


def read_document_stream(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_findings(docs: DataFrame, fmt: str = "txt", pack: str = "basic5") -> DataFrame:
    """Findings of a (streaming or batch) documents DataFrame.  Plain text
    and markdown skip documents that cannot hold a finding before their
    lines are split (exact pre-filter, see ``checks.document_findings``)."""
    docs = docs.select("doc_id", "text")
    if fmt in ("txt", "md"):
        return document_findings(docs, SEGMENTERS[fmt], pack)
    return automated_findings(SEGMENTERS[fmt](docs), pack)


def start_review_stream(spark: SparkSession, source_path: str, sink_path: str,
                        checkpoint_location: str, fmt: str = "txt", pack: str = "basic5",
                        available_now: bool = True):
    """Start the streaming review; returns the ``StreamingQuery``."""
    findings = stream_findings(read_document_stream(spark, source_path), fmt, pack)
    findings = findings.observe(METRICS, *[c.alias(k) for k, c in report_metrics("all12").items()])
    w = (findings.writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def observed_counts(query) -> dict:
    """The metrics of a review stream (``report.report_metrics``), added up over the
    batches that its progress reports still hold: no job of their own."""
    total: dict = {}
    for p in query.recentProgress:
        row = p["observedMetrics"].get(METRICS)
        for k, v in (row.asDict() if row is not None else {}).items():
            total[k] = total.get(k, 0) + (v or 0)
    return total


def summary_stream(findings: DataFrame) -> DataFrame:
    """Running dimension x severity counts of a findings stream.  The state
    is one row per (dimension, severity) — bounded by the fixed lists — so
    ``complete`` output mode is safe for an unbounded stream."""
    from pyspark.sql import functions as F
    return (findings.withColumn("severity", F.coalesce("severity", F.lit("P3")))
            .groupBy("dimension", "severity").agg(F.count(F.lit(1)).alias("n")))


def start_summary_stream(spark: SparkSession, source_path: str, checkpoint_location: str,
                         query_name: str = "review_summary", fmt: str = "txt",
                         pack: str = "basic5", available_now: bool = True):
    """Maintain the running summary in an in-memory table ``query_name``
    (``complete`` mode); returns the ``StreamingQuery``."""
    findings = stream_findings(read_document_stream(spark, source_path), fmt, pack)
    w = (summary_stream(findings).writeStream.format("memory").queryName(query_name)
         .outputMode("complete").option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
