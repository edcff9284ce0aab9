"""Connected components for entity resolution and clusters of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.session import Rounds, checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches.

    Every round a node takes the smallest label among its neighbours' and then that label's own label, so
    chains shorten by doubling. Minima are pre-aggregated; labels are stored between rounds. A node with very many
    edges, and a label of very many nodes, are split by the skew-join rule: both sides of these joins are stored tables.
    """
    both = checkpointed(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    rounds = Rounds(edges.sparkSession)
    labels = rounds.keep(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = labels.withColumnRenamed("node", "other").withColumnRenamed("component", "c")
        low = both.join(seen, "other").groupBy("node").agg(F.min("c").alias("m"))
        stepped = labels.join(low, "node", "left").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = stepped.select(F.col("node").alias("component"), F.col("component").alias("j"))
        new = rounds.keep(stepped.join(jump, "component", "left").select("node", F.least("component", "j").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component != old").isEmpty():
            return rounds.last(labels)
