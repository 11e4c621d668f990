"""Connected components by alternating star contractions, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpoint


def _least(pairs: DataFrame) -> DataFrame:
    """Of each node u the least of its neighbours and itself; aggregated before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component``: every node of the edges with the least node of its component.

    Large-star and small-star rounds (a node of any degree is one row of minima that its edges
    join, never a collected group). Rounds end when no edge changes; the number of rounds grows
    with the logarithm of the longest chain. Null ends and loops are ignored; no edges, no rows.
    """
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now = checkpoint(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: greater neighbours of u move to u's least.
        large = both.filter(F.col("v") > F.col("u")).join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        # Small star: lesser neighbours of u and u itself move to the least of them.
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = checkpoint(small.filter(F.col("u") != F.col("v")).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
