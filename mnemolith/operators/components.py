"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.util import materialise


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, root`` for the undirected ``edges(u, v)``; ``root`` is the smallest node of the component.

    Each round is two aggregations with map-side combining; a node of very many neighbours only ever sends its
    neighbours to its smallest one, so hubs shrink from round to round. Rounds are written to the shared folder; their
    number grows with the logarithm of the largest component. Null ends are ignored, loops keep their node.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.where("u <> v")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e = materialise(small.where("u <> v"), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if before == now:
            break
        before = now
    root = e.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("root", "node").alias("root"))
