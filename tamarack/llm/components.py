"""Connected components of links between long keys, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest key of its component) of all nodes but the roots; links have long u and v.

    A large star links every larger neighbour of a node to the smallest of the node and its neighbours; a small
    star links a node and its smaller neighbours to the smallest of these. Each link becomes one link, so their
    number never grows. Every step is written to the shared folder: lineage stays short, a lost executor costs a
    re-read, and a join with one row per node is a broadcast or a join that divides a hub, as the measured size
    asks. Rounds grow with the logarithm of the longest chain; they end when every node has but one neighbour,
    a smaller one, or only larger ones.

    Defined results: no links, or links of a node with itself alone, give no rows; repeated and reversed links count
    once; a link with a null end is left out.
    """
    edges = links.select("u", "v").filter("u != v")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("high")), "nearest")
        if near.filter("m < u AND m != high").isEmpty():
            return near.filter("m < u").select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = both.filter("v > u").join(near.select("u", F.least("m", "u").alias("m")), "u")
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small, "small-star")
