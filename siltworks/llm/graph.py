"""Connected components by alternating large-star and small-star steps, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; a component is named by its least node.

    Each round moves every node's neighbours to the least neighbour, so hubs shrink to stars;
    the number of rounds is logarithmic in the longest path. Each round is one or two
    shuffles of the remaining edges; lineage is cut in the shared checkpoint folder.
    Null ends and loops are dropped; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = checkpointed(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = checkpointed(new)
        same = new.count() == e.count() and new.subtract(e).isEmpty()
        e = new
        if same:
            break
    named = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
