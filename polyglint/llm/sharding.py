"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are range-partitioned by their order and written with the number of their
partition.  The totals of the partitions, one small row each, become offsets by
a running sum; inside a partition a window adds the bytes before each row.  That
prefix sum alone decides the shard: the one of the equal targets in which the
middle of the row lies.  Shards are contiguous in the order, and a shard's bytes
differ from its target by at most half of its first and half of its last row.

DataFrame operations only.  The running sum over partitions is the one step in
a single task; it reads one row a shuffle partition, never the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

SHARDS = 8
SALT_SEED = 7     # spreads rows that are equal in their order over the ranges


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one for its end; a null text has none but that."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(df: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("doc_id",), size_col: str = "size") -> DataFrame:
    """The rows of ``df`` with ``shard`` int (0 to ``shards`` - 1) and ``slot``
    long (place inside the shard, gapless from 0).

    Rows go by the columns ``order`` (nulls first), ties by size; rows equal in
    both may come in any order, each in one place.  A null or negative size
    counts as 0.  Rows that repeat are rows of their own, and any number of them
    may share an order key: the ranges split them.  A row of more bytes than a
    target leaves shards beside it empty.  An empty table gives an empty result.
    Columns named shard or slot are replaced; all others are kept, whatever
    their names.  Only the columns of ``df`` move (twice), so a caller that
    needs ids alone selects them first.
    """
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    salt, part, size, before, number, offset, base, total, first = fresh(
        df, "salt", "part", "bytes", "before", "number", "offset", "base", "total", "first")
    keys = [F.col(c).asc_nulls_first() for c in order]
    own = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    salted = df.select(*names, own.alias(size), F.rand(SALT_SEED).alias(salt))
    ranged = written(salted.repartitionByRange(*keys, F.col(size), F.col(salt))
                     .withColumn(part, F.spark_partition_id()), "shard-ranges")

    up_to_here = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy(part).agg(F.sum(size).alias(total), F.count(F.lit(1)).alias(number))
    offsets = totals.select(part, F.coalesce(F.sum(total).over(up_to_here), F.lit(0)).alias(offset),
                            F.coalesce(F.sum(number).over(up_to_here), F.lit(0)).alias(base),
                            F.greatest(F.sum(total).over(everything), F.lit(1)).alias(total))

    inside = Window.partitionBy(part).orderBy(*keys, size, salt).rowsBetween(Window.unboundedPreceding, -1)
    doubled_middle = 2 * (F.col(offset) + F.col(before)) + F.col(size)
    cut = F.call_function("div", doubled_middle.cast("decimal(20,0)") * F.lit(shards), 2 * F.col(total))
    placed = (ranged.withColumn(before, F.coalesce(F.sum(size).over(inside), F.lit(0)))
              .withColumn(number, F.count(F.lit(1)).over(inside))
              # at most one row a shuffle partition
              .join(F.broadcast(offsets), part)
              .withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
              .withColumn(number, F.col(base) + F.col(number)))
    # at most one row a shard
    firsts = placed.groupBy("shard").agg(F.min(number).alias(first))
    return placed.join(F.broadcast(firsts), "shard").select(
        *names, "shard", (F.col(number) - F.col(first)).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    A null text is empty: size 1, checksum 0.  A null id comes first.  Texts are
    read once and never shuffled.  ``grown_shard`` is null: under the law of
    bytes one more shard moves all cuts."""
    slim = docs.select(F.col(id_col).alias("doc_id"), byte_size(F.col(text_col)).alias("size"),
                       F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_crc32"))
    return assign(slim, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                       F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows as one folder a shard (``shard=0`` and so on), rows of a
    file in the order of the shard."""
    size, = fresh(docs, "size")
    sized = docs.withColumn(size, byte_size(F.col(text_col)))
    (assign(sized, shards, (id_col,), size).drop(size)
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def oracle(shards: int = SHARDS) -> str:
    """DuckDB SQL of ``shard_documents`` over ``documents``; CRC-32 byte by byte,
    its table made from the polynomial."""
    return f"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
summed AS (
  SELECT doc_id, size, hx, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(size) OVER ()::BIGINT AS total FROM sized),
cut AS (SELECT doc_id, size, hx, least({shards - 1}, ((2 * before + size) * {shards}) // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * (size - 1), 2),
           lambda i: ('0x' || substr(hx, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])),
           4294967295)::BIGINT AS text_crc32,
       'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size) - 1)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM cut, crc_table
"""
