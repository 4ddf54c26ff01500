"""Connected components of a links table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Most rows of a small side that is broadcast (two numbers a row).
BROADCAST_ROWS = 200_000


def side(df: DataFrame) -> DataFrame:
    """df for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _smallest(edges: DataFrame, name: str) -> DataFrame:
    return side(written(edges.groupBy("u").agg(F.min("v").alias("m")), name))


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) of every node that has a link. links: a, b.

    Each round links every node's larger neighbours to its least neighbour, then every node and its
    smaller neighbours to the least of them; the rounds end when nothing changes. Round tables go to
    the shared folder, so lineage stays short and lost executors cost one round at most.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = _tally(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _smallest(both, "large").withColumn("m", F.least("u", "m"))
        large = both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        m = _smallest(large, "small")
        joined = large.join(m, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = _tally(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
