"""Connected components over an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round points nodes at the smallest
    neighbour, so paths shrink fast; each round is two grouped minima and two equi joins and is checkpointed, and none follows once components are stars.  Loops,
    repeated edges and edges with a null end are ignored; a table without edges gives no rows.
    """
    pairs = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(pairs.select("v", F.lit(0), F.lit(1)))
        # done when each node has one parent at most, and no parent has one: smaller ends are the roots then
        if ends.groupBy("node").agg(F.sum("child").alias("parents"), F.max("root").alias("root")).where("parents > 1 OR parents = 1 AND root = 1").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        both = pairs.union(pairs.select("v", "u"))
        # minima are written, so that joins read both sides through shuffles and AQE can split the edges of a hub
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        pairs = checkpointed(small.distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
