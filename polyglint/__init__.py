"""polyglint: corpus-scale review of multilingual content on Spark.

Public entry points (all return lazily planned DataFrames or dicts of them):

* ``review_documents`` / ``review_corpus`` — segment, check and deduplicate
  documents (plain text, markdown, HTML; mixed corpora routed by suffix);
* ``review_bitext`` — align a source and a target workbook cell by cell;
* ``compare_documents`` — compare document pairs by size;
* ``scan_workbook`` — language, residual and sensitive scan of a workbook;
* ``build_report`` / ``write_report`` — numbered detail and summary tables.
"""

from .operators.report import write_report
from .plans.review import (build_report, compare_documents, review_bitext, review_corpus,
                           review_documents, scan_workbook)
from .session import get_spark, size_partitions
from .sources.readers import load_parquet_documents, load_text_files

__all__ = [
    "build_report", "compare_documents", "get_spark", "load_parquet_documents",
    "load_text_files", "review_bitext", "review_corpus", "review_documents",
    "scan_workbook", "size_partitions", "write_report",
]
