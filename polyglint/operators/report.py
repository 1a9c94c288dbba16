"""Findings report: merge, numbered detail table, dimension x severity
summary, JSON reader and sinks.

The summary is computed from one grouped pass over the findings (a pivot
with the four fixed severities); zero rows come from a broadcast left join
against the fixed dimension list, and the grand total is summed from the
small per-dimension table, not from the findings again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as C
from ..plans.strategy import number_rows
from .summary import dimensions_table

# order of findings: by input, document, pass and place; of findings read from
# files by file and the place in it
ORDER_COLS = ["stream", "doc_id", "phase", "seq", "sub", "file", "block", "pos"]
FILE_COLS = ["file", "block", "pos"]

FINDING_SCHEMA = T.StructType([
    T.StructField("dimension", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("description", T.StringType()),
])
def severities_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.SEVERITIES, "severity string, sev_rank bigint, fill_rgb string")


def merge_findings(*dfs: DataFrame) -> DataFrame:
    """Bag union of findings from several detectors/inputs, tagging each
    input with its position (``stream``) so the merged order is defined."""
    tagged = [df.withColumn("stream", F.lit(i).cast("bigint")) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def with_defaults(findings: DataFrame) -> DataFrame:
    """Missing severity -> P3; missing dimension/location/description -> ''."""
    return findings.withColumns({
        "severity": F.coalesce(F.col("severity"), F.lit(C.DEFAULT_SEVERITY)),
        "dimension": F.coalesce(F.col("dimension"), F.lit("")),
        "location": F.coalesce(F.col("location"), F.lit("")),
        "description": F.coalesce(F.col("description"), F.lit("")),
    })


def _order_cols(df: DataFrame) -> list:
    return [c for c in ORDER_COLS if c in df.columns]


def report_detail(findings: DataFrame) -> DataFrame:
    """Numbered detail table (n, location, description, severity, dimension,
    fill_rgb) in finding order.  The numbering is a global 1..N in the total
    order of the ordering columns, done with range partitioning and
    per-partition offsets (no single-partition window)."""
    f = with_defaults(findings)
    sev = F.broadcast(severities_table(findings.sparkSession).select("severity", "fill_rgb"))
    f = f.join(sev, "severity", "left")
    order = _order_cols(f)
    # equal places, and findings that say nothing of theirs, fall back on the
    # contents, so that the numbering is the same in every run
    order = [*order, *[c for c in ("location", "description", "severity", "dimension") if c not in order]]
    numbered = number_rows(f, order, "n")
    return numbered.select("n", "location", "description", "severity", "dimension", "fill_rgb")


def _dims(dims) -> list[str]:
    if dims == "core10":
        return C.DIMENSIONS_CORE10
    if dims == "all12":
        return C.DIMENSIONS_ALL12
    return list(dims)


def report_summary(findings: DataFrame, dims="core10") -> DataFrame:
    """Dimension x severity counts, every listed dimension present (zeros
    kept), ``total`` per row, then the grand-total row (dimension 总计).
    Only listed dimensions and the severities P0..P3 are counted.

    One pass: ``rollup(dimension)`` with a conditional count per severity
    yields the per-dimension rows and the grand total together; they are
    joined to the fixed dimension list (plus the total label), so empty
    dimensions and an empty input still give every row."""
    spark = findings.sparkSession
    names = _dims(dims)
    f = with_defaults(findings).filter(F.col("dimension").isin(names)
                                       & F.col("severity").isin(C.SEVERITY_NAMES))
    counts = (f.rollup("dimension")
              .agg(*[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITY_NAMES])
              .withColumn("dimension", F.coalesce(F.col("dimension"), F.lit(C.GRAND_TOTAL_LABEL))))
    dim_t = dimensions_table(spark, list(names) + [C.GRAND_TOTAL_LABEL])
    out = dim_t.join(counts, "dimension", "left").select(
        "dim_ord", "dimension",
        *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in C.SEVERITY_NAMES])
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in C.SEVERITY_NAMES]))


def report_rejects(findings: DataFrame, dims="core10") -> DataFrame:
    """Findings of a listed dimension whose severity is not P0..P3 (the
    summary cannot place them)."""
    f = with_defaults(findings)
    return f.filter(F.col("dimension").isin(_dims(dims))
                    & ~F.col("severity").isin(C.SEVERITY_NAMES))


def report_assessment(summary: DataFrame, assessment: str | None) -> DataFrame:
    """Append the free-text assessment as one labelled row after the totals."""
    if not assessment:
        return summary.withColumn("note", F.lit(None).cast("string"))
    spark = summary.sparkSession
    row = spark.createDataFrame(
        [(10_000, "assessment", assessment)], "dim_ord bigint, dimension string, note string")
    return summary.withColumn("note", F.lit(None).cast("string")) \
        .unionByName(row, allowMissingColumns=True)


def markdown_summary(summary: DataFrame) -> DataFrame:
    """Summary rows as Markdown table lines (``| dim | P0 | ... |``), with
    ``dim_ord`` kept for ordering; the header lines have ord -2 and -1."""
    spark = summary.sparkSession
    cols = ["dimension"] + C.SEVERITY_NAMES + ["total"]
    heads = [C.SUMMARY_HEADINGS[c] for c in cols]
    header = spark.createDataFrame(
        [(-2, "| " + " | ".join(heads) + " |"),
         (-1, "|" + "|".join(["---"] * len(cols)) + "|")], "dim_ord bigint, line string")
    body = summary.select("dim_ord", F.concat(
        F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]), F.lit(" |"))
        .alias("line"))
    return header.unionByName(body)


# --------------------------------------------------------------------------
# sources and sinks
# --------------------------------------------------------------------------

def _records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """(file, block, pos, record, v, kind): each JSON value of the files as it
    stands there and as a VARIANT (null: not JSON), and its kind (ARRAY, OBJECT,
    or the type of a scalar).  Blank lines and empty files hold no record."""
    raw = spark.read.text(path, wholetext=multi_line).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.btrim("value", F.lit(" \t\r\n")).alias("record"))
    v = F.try_parse_json("record")
    return raw.where(F.col("record") != "").withColumn("v", v).withColumn(
        "kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))


def _listed(records: DataFrame, multi_line: bool, findings_key: str) -> DataFrame:
    """``records`` with ``items``: the findings that each of them holds, an array
    of VARIANT; null where the record can't hold findings."""
    as_list = lambda path: F.try_variant_get("v", path, "array<variant>")
    if not multi_line:
        return records.withColumn("items", F.when(F.col("kind") == "OBJECT", F.array("v")))
    key = F.try_variant_get("v", f"$.{findings_key}", "variant")
    return records.withColumn("items", F.when(F.col("kind") == "ARRAY", as_list("$")).when(
        (F.col("kind") == "OBJECT") & key.isNull(), F.array().cast("array<variant>")).when(
            F.col("kind") == "OBJECT", as_list(f"$.{findings_key}")))


def _items(records: DataFrame, multi_line: bool, findings_key: str) -> DataFrame:
    listed = _listed(records, multi_line, findings_key)
    return listed.select("file", "block", F.col("pos").alias("p"), F.posexplode("items").alias("k", "item")).select(
        "file", "block", (F.col("p") + F.col("k")).alias("pos"), "item",
        F.schema_of_variant("item").startswith("OBJECT").alias("is_finding"))


def read_findings(spark: SparkSession, path: str, multi_line: bool = True,
                  findings_key: str = "findings") -> tuple[DataFrame, DataFrame]:
    """Read findings JSON.  With ``multi_line`` each file is one JSON value (of at
    most 128 MB): a list of findings, or an object whose ``findings_key``
    (``findings``, or ``automated_findings`` for the output of a review) holds
    one, with an ``assessment``; an object without that key holds none.  Without
    it, each line is one finding (the form our own sinks write, splittable at
    any size).

    Returns (findings, assessments).  Any object in a list is a finding, also
    ``{}`` and one of unknown keys: what it doesn't say is null (the report files
    it as P3).  Findings carry the file, the block of it and the place therein,
    which order them as they stand.  What isn't JSON, or can't be or hold a
    finding, is listed by ``read_rejects``; it ends no run."""
    if findings_key not in ("findings", "automated_findings"):
        raise ValueError(f"unknown findings key {findings_key!r}")
    records = _records(spark, path, multi_line)
    field = lambda c: F.try_variant_get("item", f"$.{c}", "string").alias(c)
    found = _items(records, multi_line, findings_key).where("is_finding").select(
        *FILE_COLS, *[field(f.name) for f in FINDING_SCHEMA])
    assessments = records.where(F.col("kind") == "OBJECT").select(
        "file", F.try_variant_get("v", "$.assessment", "string").alias("assessment")).where("assessment is not null")
    return found, assessments


def read_rejects(spark: SparkSession, path: str, multi_line: bool = True, findings_key: str = "findings") -> DataFrame:
    """(file, record): what ``read_findings`` can't read: records as they stand in
    their file, and entries of lists that are no objects."""
    records = _records(spark, path, multi_line)
    whole = _listed(records, multi_line, findings_key).where(F.col("items").isNull()).select("file", "record")
    entries = _items(records, multi_line, findings_key).where("not is_finding").select("file", F.to_json("item").alias("record"))
    return whole.unionByName(entries)


def ingest_manual(findings: DataFrame, manual: DataFrame) -> DataFrame:
    """Append findings a reader wrote (any dimension) after the automated ones,
    in the order of their files."""
    return merge_findings(findings, manual)


def finding_json(findings: DataFrame) -> DataFrame:
    """One JSON line per finding, non-ASCII kept."""
    return findings.select(F.to_json(F.struct("dimension", "severity", "location",
                                              "description")).alias("json"))


def write_review(df: DataFrame, path: str, fmt: str = "json",
                 partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def report_metrics(dims="core10") -> dict:
    """Named aggregates of findings for ``observe``: findings, rejects (see
    ``report_rejects``), findings of other dimensions, and each cell of the summary."""
    dimension, severity = F.coalesce("dimension", F.lit("")), F.coalesce("severity", F.lit(C.DEFAULT_SEVERITY))
    listed, known = dimension.isin(_dims(dims)), severity.isin(C.SEVERITY_NAMES)
    cells = {f"{i}_{s}": F.count_if((dimension == d) & (severity == s)) for i, d in enumerate(_dims(dims)) for s in C.SEVERITY_NAMES}
    return {"findings": F.count(F.lit(1)), "rejects": F.count_if(listed & ~known), "unlisted": F.count_if(~listed), **cells}


def observed(df: DataFrame, name: str, metrics: dict) -> tuple[DataFrame, Observation]:
    """``df`` with the metrics gathered by whatever job first reads all of it."""
    obs = Observation(name)
    return df.observe(obs, *[c.alias(k) for k, c in metrics.items()]), obs


def summary_of_metrics(spark: SparkSession, counts: dict, dims="core10") -> DataFrame:
    """``report_summary`` out of observed metrics: a table of the fixed lists'
    size, for which the findings aren't read again."""
    names = _dims(dims)
    rows = [[counts.get(f"{i}_{s}") or 0 for s in C.SEVERITY_NAMES] for i in range(len(names))]
    rows.append([sum(c) for c in zip(*rows)])
    return spark.createDataFrame([(i, d, *row, sum(row)) for i, (d, row) in enumerate(zip([*names, C.GRAND_TOTAL_LABEL], rows))],
                                 "dim_ord bigint, dimension string, " + ", ".join(f"{s} bigint" for s in C.SEVERITY_NAMES) + ", total bigint")


def write_report(findings: DataFrame, path: str, dims="core10", assessment: str | None = None,
                 fmt: str = "parquet") -> dict:
    """Write the detail and summary tables (report headings as column
    names) under ``path`` and return the run status.  The summary and the counts
    in the status are metrics of the one job that writes the detail table."""
    spark = findings.sparkSession
    detail, obs = observed(report_detail(findings), "report", report_metrics(dims))
    detail = detail.select(*[F.col(c).alias(C.DETAIL_HEADINGS.get(c, c)) for c in detail.columns])
    detail.write.mode("overwrite").format(fmt).save(f"{path}/{C.DETAIL_SHEET}")
    counts = obs.get
    summary = report_assessment(summary_of_metrics(spark, counts, dims), assessment)
    summary = summary.select(*[F.col(c).alias(C.SUMMARY_HEADINGS.get(c, c))
                               for c in summary.columns])
    summary.coalesce(1).write.mode("overwrite").format(fmt).save(f"{path}/{C.SUMMARY_SHEET}")
    return run_status(path, counts)


def run_status(output: str, counts: dict) -> dict:
    """What a run wrote: counts of findings, of rejects and of findings of
    dimensions that aren't listed, from its observed metrics."""
    number = lambda k: int(counts.get(k) or 0)
    return {"status": "success", "output_file": output, "findings_count": number("findings"),
            "rejects_count": number("rejects"), "unlisted_count": number("unlisted"),
            "sheets": [C.DETAIL_SHEET, C.SUMMARY_SHEET]}
