"""Connected components by alternating large and small stars, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch, written

#: Rounds until an error; a component of n nodes takes some log2(n) of them.
MAX_ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one (or to itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; root is the component's smallest node.

    edges: u, v (long), in any direction; loops and repeated edges don't matter.
    """
    with scratch():
        now = written(small_star(edges.where("u <> v").distinct()), "stars")
        stamp = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        last = now.agg(stamp).first()[0]
        for _ in range(MAX_ROUNDS):
            now = written(small_star(large_star(now)), "stars")
            this = now.agg(stamp).first()[0]
            if this == last:
                return kept(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
            last = this
    raise RuntimeError("components did not settle")
