"""Connected components of a large, sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (u, v: long); root is the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., 2014): each round links the
    neighbours of a node to the least of them, which keeps the components, never adds edges and
    ends with a star around each least node after O(log^2 n) rounds. The least neighbour comes
    from a partial aggregate and is joined back, so a hub's edges are never gathered in one task.
    Each round is cut off in the shared checkpoint folder. Self-loops and repeated edges are fine;
    an empty graph gives no rows.
    """
    a, b = F.greatest("u", "v"), F.least("u", "v")
    now = cut(edges.where("u IS NOT NULL AND v IS NOT NULL").select(a.alias("u"), b.alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        both = now.where("u <> v").select("u", "v").union(now.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    every = edges.select("u").union(edges.select("v")).where("u IS NOT NULL").distinct().withColumnRenamed("u", "node")
    star = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return every.join(star, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
