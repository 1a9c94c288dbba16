"""Connected components of a link table, as alternating star contractions.

Every round is two groupings and two joins on long columns; nothing is
collected.  A star whose centre has a third of all nodes is met with partial
minima before the shuffle, and the join of minima back to the links is one
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _saved(df: DataFrame) -> tuple[DataFrame, tuple]:
    out = df.checkpoint(eager=True)
    sig = out.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return out, tuple(sig)


def _large_star(e: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked with the smallest node near it."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = (e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u long, v long) -> (node, component): every node that has a
    link, with the smallest node that links reach from it.  Links with a null
    end, and those of a node with itself, say nothing and are left out; a node
    without any other link is not in the result.

    Links are contracted to stars (large-star and small-star steps in turn)
    until a round changes nothing, each round saved with ``checkpoint()``.
    """
    checkpoint_dir(links.sparkSession)
    e, sig = _saved(links.where("u is not null and v is not null and u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while sig[0]:
        nxt, new = _saved(_small_star(_large_star(e)))
        if new == sig:
            break
        e, sig = nxt, new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
