"""Connected components by alternating stars (large-star, small-star), with tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    """Join the larger neighbours of each node to the smallest of its neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    both = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")
    return e.join(least, "u").select(both).select("x.u", F.col("x.m").alias("v")).where("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes that have an edge to another node: node, component (its smallest node).

    Runs until nothing changes, which takes a number of rounds logarithmic in practice. Null ends are ignored.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = cut_lineage(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if not mark.n or mark == before:
            break
        before = mark
        e = cut_lineage(_small_star(_large_star(e).distinct()).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
