"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.store import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge that is not the smallest of its component; ``component`` is that smallest node.

    Every step combines minima before its shuffle and joins them back, so a node with very many neighbours is a skewed side of a
    join, which Spark splits, and never one gathered group. The number of rounds grows with the logarithm of the longest chain.
    Null ends and loops are ignored.
    """
    pair = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
    now = written(pair.distinct(), "components", narrow=True)
    state = _state(now)
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("low")).select(F.col("u").alias("u2"), F.least("u", "low").alias("m"))
        large = both.join(low, both["u"] == low["u2"]).where("w > u").select(F.col("w").alias("v"), "m").distinct()
        mine = large.groupBy("v").agg(F.min("m").alias("low")).withColumnRenamed("v", "v2")
        hooked = large.join(mine, large["v"] == mine["v2"])
        small = hooked.select("v", F.col("low").alias("m")).unionByName(hooked.where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m")))
        then = written(small.distinct(), "components", narrow=True)
        new = _state(then)
        dropped(now)
        now = then
        if new == state:
            return now.select(F.col("v").alias("node"), F.col("m").alias("component"))
        state = new
