"""Connected components of an edge table by alternating large-star and small-star steps.

Each step groups edges by a node and sends neighbours to the smallest one; an edge table never grows, hubs
aggregate with partial sums, and every round is written to the shared folder, so lost executors cost one
round. Nothing is collected but one counter a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that it reaches."""
    e = staged(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        # Large star: each node sends its larger neighbours to the least node it knows, itself included.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node sends its smaller neighbours and itself to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        same = after.join(e, ["u", "v"], "left_anti").limit(1).count() == 0 and after.count() == e.count()
        discard(e)
        e = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
