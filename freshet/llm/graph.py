"""Connected components as DataFrame rounds: smallest neighbour label, then a pointer jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every end of ``edges`` (a, b: longs); label is the smallest node reachable.

    Every round is written to the shared folder, so lineage stays short and lost
    executors cost one round. Labels at least halve their distance in a round;
    ``most_rounds`` is never met by finite input and raises if it is.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = scratch.keep(both.distinct(), f"{name}-edges")
    now = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
    now, last = scratch.keep(now, f"{name}-0"), None
    for k in range(1, most_rounds):
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("low"))
        low = now.join(near, now["node"] == near["a"]).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        low = scratch.keep(low, f"{name}-low{k}")
        up = low.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = low.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"), "was")
        after = scratch.keep(jumped, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-low{k}")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        now = after.select("node", "label")
    raise RuntimeError(f"components of {name} did not settle in {most_rounds} rounds")
