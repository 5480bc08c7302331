"""Connected components of a table of links, by alternating star steps.

Each round links every node to the smallest node that its neighbours know; the rounds
needed grow with the logarithm of the longest chain. A round is written to the shared
folder, so its lineage is short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import drop, stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node."""
    edges = stored(links.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        wide = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        before, edges = edges, stored(wide.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop([before])
        # Done when every link leads straight to a smallest node.
        if edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
