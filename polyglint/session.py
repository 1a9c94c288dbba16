"""Session helpers: defaults for a review job and a reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a review job wants on any cluster.  AQE re-plans joins at runtime
# (size-checked broadcast, skew-join splitting, partition coalescing).
JOB_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

PARTITION_BYTES = 128 << 20


def size_partitions(spark: SparkSession, input_bytes: int,
                    partition_bytes: int = PARTITION_BYTES) -> int:
    """Size shuffles and scan splits for an input of ``input_bytes``: one
    shuffle partition per ``partition_bytes`` of input (at least one per
    core), scan splits of the same size.  AQE coalesces partitions that turn
    out small, so erring high is cheap; erring low spills.  Returns the
    shuffle partition count."""
    import math
    n = max(spark.sparkContext.defaultParallelism, math.ceil(input_bytes / partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(partition_bytes))
    return n


def get_spark(master: str | None = None, app: str = "polyglint",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the job defaults applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**JOB_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured *and* the session runs in local mode (tests)
    do we create a folder of our own; on a cluster a machine-local folder would
    not survive the loss of an executor, so we refuse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="polyglint-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder (never local): one
    job computes the rows and writes them.  ``spark.cleaner.
    referenceTracking.cleanCheckpoints`` removes the files with the frame."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Tables whose rows carry prose: every row costs regex work, so a scan that
# yields fewer tasks than the cluster has cores is spread out before it.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


SPREAD_BYTES = 1 << 30


def spread_scan(df: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Round-robin a small scan that is narrower than the cluster (a file with
    one row group is read by a single task) over one partition per core.
    Inputs over ``max_bytes`` are left as they are however many cores there
    are: their text is not shuffled for this."""
    target = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= max_bytes and df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


# A plan that reads a cached input prints that one's plan wherever it is mentioned,
# and Spark keeps such texts of its last 1,000 queries on the driver.
PLAN_TEXT, PLAN_TEXT_CHARS = "spark.sql.maxPlanStringLength", 1 << 20


def bound_plan_texts(spark: SparkSession) -> None:
    """At most ``PLAN_TEXT_CHARS`` characters of a plan's text, where the session
    leaves Spark's default (2 GB)."""
    if int(spark.conf.get(PLAN_TEXT, str((1 << 31) - 16))) >= (1 << 31) - 16:
        spark.conf.set(PLAN_TEXT, str(PLAN_TEXT_CHARS))


_SCANS: dict[tuple, DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str,
               spread: bool | None = None) -> DataFrame:
    """Read a bundled table; text tables are spread when the scan is narrow.
    The DataFrame is built once per application (DataFrames are immutable,
    so every query of a run can share it)."""
    bound_plan_texts(spark)
    spread = spread if spread is not None else name in TEXT_TABLES
    key = (spark.sparkContext.applicationId, table_path(sf_dir, name), spread)
    if key not in _SCANS:
        df = spark.read.parquet(table_path(sf_dir, name))
        _SCANS[key] = spread_scan(df) if spread else df
    return _SCANS[key]
