"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    """Count and an order-free sum of hashes: equal before and after a round that changes nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """One row (node, root) for each node of links; root is the smallest node reachable, itself included.

    Links are undirected; repeated ones, loops and links with a null end change nothing (a node with
    only a loop isn't returned). Each round every node hangs its larger neighbours, then its smaller
    ones, on the smallest node it knows; the rounds grow with the logarithm of the longest chain.
    Minima are taken by partial aggregation, so a node with very many links is no task of its own.
    """
    a, b = F.col(left), F.col(right)
    edges = checkpointed(links.where(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct())
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("low", "node").alias("low"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(F.explode(F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))).alias("e")).select("e.*").where("node != root").distinct()
        edges = checkpointed(small)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges
