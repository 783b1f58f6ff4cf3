"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, settle: bool = True) -> DataFrame:
    """``node, component`` for every node of an edge; ``component`` is the smallest node reachable.

    Each round rewires every node to the smallest node it knows (Kiveris et al., 2014), so a path of n
    nodes needs O(log n) rounds instead of n. Edges are written to the shared folder between rounds.
    Null ends and loops are ignored; an empty table gives an empty result. Raises if ``max_rounds``
    do not suffice rather than returning labels that are not final. With ``settle`` false it stops there
    instead: nodes of one label are then connected, but a component may still have several labels.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = scratch.table(pairs.where("u <> v").distinct(), "0")
    seen = state(current)
    for k in range(1, max_rounds + 1):
        if not seen[0]:
            break
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        current = scratch.table(small.distinct(), str(k))
        now = state(current)
        scratch.drop(str(k - 1))
        if now == seen:
            break
        seen = now
    else:
        if settle:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    ends = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = ends.union(current.select(F.col("v"), F.col("v")).distinct())
    return ends if settle else ends.groupBy("node").agg(F.min("component").alias("component"))
