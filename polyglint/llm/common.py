"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1024           # rows that are texts go to the workers so many at a time

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a source
    tree (an installed package, or one shipped with ``--py-files``, needs
    nothing)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to open."""
    attach(spark)
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{table}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package made importable in the workers.

    A worker process serves one operator after the other: what others have
    kept there (``kept``, under another name than ``keeps``) is dropped first.

    Rows are whole texts here, a batch of which stands outside of the heap on both
    sides: where the session leaves Spark's default of 10,000 rows a batch,
    ``TEXT_ROWS`` are set for it."""
    spark = df.sparkSession
    attach(spark)
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        return fn(it)

    return df.mapInArrow(task, schema)


_KEPT: dict[str, tuple] = {}


def kept(name: str, key, make: Callable):
    """``make()``, made once in a worker process and kept under ``name`` from
    task to task while operators that keep this name run there."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT[name] = (key, make())
    return _KEPT[name][1]


def forget_others(name: str | None) -> None:
    others = [n for n in _KEPT if n != name]
    for other in others:
        del _KEPT[other]
    if others:                  # given back to the system, not kept for the next operator
        gc.collect()
        pa.default_memory_pool().release_unused()


SLICE_ROWS = 512


def slices(it: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The record batches in pieces of at most ``rows`` rows, which bounds what
    is held as Python objects at a time."""
    for batch in it:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path inside the folder that ``spark.checkpoint.dir`` names, which
    the driver and all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the
    lineage is cut, and a lost executor costs nothing that was computed."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> list[Column]:
    """Two columns that identify a text: a 64-bit hash and its length.  A null
    text has the key of the empty one."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("text_hash"), F.octet_length(t).alias("text_len")]


def batches_of(it: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The record batches, in slices, with one string column as Python strings
    (null: empty)."""
    for batch in slices(it):
        yield batch, [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def id_ranges(df: DataFrame, id_col: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with an integer column that deals it into ranges of ascending
    ``id_col`` of about equal size; all rows of an id, and those without one
    (in range 0), share a range.

    The edges are quantiles, fixed before anything is shuffled: the same row is
    in the same range whenever a task runs again.  By default there are four
    ranges to a shuffle partition.
    """
    spark = df.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    edges = df.agg(F.percentile_approx(id_col, shares, 20 * ranges).alias("e")).first()["e"] if shares else []
    edges = sorted(set(edges or []))
    group = max(1, round(len(edges) ** 0.5))
    coarse, fine = edges[::group], [edges[s + 1:s + group] for s in range(0, len(edges), group)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda e: e <= F.col(id_col)))

    def longs(values: list) -> str:
        return f"cast(array({','.join(f'{v}L' for v in values)}) as array<bigint>)"

    if not edges:
        return df.withColumn(name, F.lit(0))
    k = below(F.expr(longs(coarse)))
    inner = F.element_at(F.expr(f"array({','.join(map(longs, fine))})"), k)
    return df.withColumn(name, F.when(F.col(id_col).isNull() | (k == 0), F.lit(0))
                         .otherwise((k - 1) * group + 1 + below(inner)).cast("int"))
