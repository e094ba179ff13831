"""Connected components of a distributed edge list, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """id, component: the least id reachable from each id that has an edge.

    Labels stay in tables; each round takes the least label of the neighbours and
    then the label of that label, so paths shorten exponentially. Loops, repeated
    edges and null ends are ignored. Every round is materialised in the shared
    checkpoint folder.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter(F.col("a") != F.col("b"))
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        best = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = cut(best.join(jump, "component").select("id", "old", F.least("component", "next").alias("component")))
        if new.filter(F.col("component") != F.col("old")).isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
