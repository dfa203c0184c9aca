"""Connected components of an undirected graph held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (a, b).

    Labels go along the edges and are then replaced by their own labels, so that the rounds grow with the logarithm of
    the longest path; each round is written to the shared folder. A node's many edges are reduced before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        told = both.join(labels, F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("told"))
        near = labels.join(told, "id").select("id", F.least("component", "told").alias("near"), F.col("component").alias("old"))
        far = near.select(F.col("id").alias("near"), F.col("near").alias("far"))
        new = written(near.join(far, "near").select("id", F.least("near", "far").alias("component"), "old"), "labels")
        if new.where("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
