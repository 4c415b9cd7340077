"""Connected components of a table of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes; the
    number of rounds grows with the logarithm of the longest path, and graphs of
    stars take two. A node with very many links is met only by its minimum, in a
    join that splits skewed keys. Rounds are written to the shared folder, so a
    lost executor costs one round at most.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")]
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = edges.agg(*sums).first()
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour, and the node itself, is linked to the least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: smaller neighbours and the node itself are linked to the least one
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(*sums).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
