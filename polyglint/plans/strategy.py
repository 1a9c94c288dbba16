"""Physical-plan choices a Spark user makes explicitly.

* ``checked_broadcast``: broadcast a side only when its row count is proven
  below a bound; beyond it the join stays a shuffle join that AQE can still
  convert or split at runtime.
* ``key_filter``: drop rows whose key occurs nowhere on the other side before
  they are shuffled, by a broadcast of fixed size.
* ``with_range`` / ``number_rows``: a dense, global 1..N numbering in a total
  order.  The edges of the ranges are keys of the rows themselves, drawn by a
  hash and so the same in every run; a row finds its range by binary search.
  Rows then move once, to their range: a window numbers them there, and the
  counts of the ranges, taken from the very same shuffle, become the offsets.
  Nothing is persisted or checkpointed, and a task that runs again gives the
  same rows the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default bound for broadcasting a derived side.  Rows of the small tables we
# broadcast (sheet maps, glossaries) are ~100 bytes, so the bound keeps a
# broadcast near 50 MB; anything larger stays a shuffle join.
BROADCAST_MAX_ROWS = 500_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows,
    else ``df`` unchanged (a shuffle join; AQE re-plans it at runtime).
    ``df`` should be cached or cheap: its row count is computed here."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


# Bits of a key filter: 4,096 bitmaps of 4 KB, whatever the data.
FILTER_BITS = 1 << 27


def key_filter(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``keys`` may occur in ``other``: those that are in
    a Bloom filter (of one hash) of the keys there.  Few others pass, and none is
    missing; whoever needs just the former joins ``other`` afterwards, when hardly
    any other row is left to shuffle.

    The filter is a table of bitmaps of a fixed size in total, so its broadcast
    needs no look at the data.  It reads every column of ``other``: whoever reads
    just these too shares what was shuffled for it.  Null keys are in no filter's
    way: they hash like any other value."""
    # the coalesce says that it is never null, so that joins put no filter on it
    bit = F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)), F.lit(0)) + 1
    bitmaps = other.select(bit.alias("b"), F.xxhash64(*other.columns).alias("all")).groupBy(
        F.bitmap_bucket_number("b").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bitmap"), F.bit_xor("all").alias("all")).where(
                "all is not null").drop("all")
    at = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (df.withColumn("_bucket", F.bitmap_bucket_number(bit))
            .join(F.broadcast(bitmaps), "_bucket").where(F.getbit(byte, at % 8) == 1).drop("_bucket", "_bitmap"))


# Edges travel inside the plan: so many at most, whatever the number of rows.
MAX_RANGES = 4096
DRAWN_PER_RANGE = 8


def lower_bound(values: Column, size: Column, below) -> Column:
    """How many of the first elements of a sorted array satisfy ``below`` (which
    holds up to some element and for none from there on): binary search, with as
    many steps as ``size`` (an INT column, the length of the array) needs."""

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        return F.when(lo >= hi, acc).when(
            below(F.element_at(values, mid + 1)), F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(
            F.struct(lo.alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int"))
    return F.when(size == 0, F.lit(0)).otherwise(
        F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), step)["lo"])


def range_edges(df: DataFrame, key: Column, ranges: int) -> tuple[Column, int]:
    """At most ``ranges - 1`` keys that part the rows of ``df`` into ranges of
    about equal numbers of different keys, ascending, as one literal array, and
    their number.

    Of the keys in each of ``DRAWN_PER_RANGE * ranges`` hash buckets the one of
    the least hash is drawn, which is a uniform sample in one mergeable
    aggregate, the same in every run.  The drawn keys meet in one small row."""
    keys = df.select(key.alias("k"))
    drawn = (keys.select("k", F.xxhash64("k").alias("h"))
             .groupBy(F.pmod("h", F.lit(DRAWN_PER_RANGE * ranges)).alias("b")).agg(F.min_by("k", "h").alias("k")))
    every = F.filter("s", lambda _, i: i % DRAWN_PER_RANGE == DRAWN_PER_RANGE - 1)
    row = drawn.agg(F.sort_array(F.collect_list("k")).alias("s")).select(
        F.to_json(every).alias("edges"), F.size(every).alias("n")).first()
    return F.from_json(F.lit(row["edges"]), T.ArrayType(keys.schema["k"].dataType)), row["n"]


def sort_key(order: list) -> Column:
    """The order (names or columns, ascending, nulls first) as one comparable value."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])


def with_range(df: DataFrame, order: list, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the INT column ``name``: the range of each row, ascending in the
    order.  Rows that are equal in it share a range.  By default there are as many
    ranges as shuffle partitions, ``MAX_RANGES`` at most."""
    if ranges is None:
        ranges = min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = sort_key(order)
    edges, n = range_edges(df, key, ranges)
    if n == 0:
        return df.withColumn(name, F.lit(0))
    found = F.transform(F.array(key), lambda k: lower_bound(edges, F.lit(n), lambda e: e <= k))
    # never null, so that no join puts a filter between the rows and their shuffle
    return df.withColumn(name, F.coalesce(F.element_at(found, 1), F.lit(0)))


def number_rows(df: DataFrame, order_cols: list, name: str = "n", ranges: int | None = None) -> DataFrame:
    """Add ``name`` = 1..N following ``order_cols``: names, or columns of any
    expression, ascending with nulls first.  They must be a total order: ties
    would make the numbering depend on row arrival order."""
    ranged = with_range(df, order_cols, "_range", ranges).repartition("_range")
    # the counts read every column, so that both sides read one and the same shuffle
    every = F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("_all")
    up_to = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    offsets = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), every).where(F.col("_all").isNotNull())
               .select("_range", F.coalesce(F.sum("_rows").over(up_to), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_range").orderBy(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
    return (ranged.withColumn("_place", F.row_number().over(inside)).join(F.broadcast(offsets), "_range")
            .withColumn(name, (F.col("_offset") + F.col("_place")).cast("bigint"))
            .drop("_range", "_offset", "_place"))
