"""Connected components of an edge table by large-star / small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinlab.llm.common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge (a, b).

    Each round points every node's neighbours at its smallest neighbour, first the larger ones, then the
    rest; distances shrink geometrically, also along chains, and every table is combined before it is
    shuffled. Rounds end when the edges stay the same.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = scratch.cut(e, f"{name}0"), None
    n = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for k in range(1, MAX_ROUNDS):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*")
        e = scratch.cut(small.filter("u <> v").distinct(), f"{name}{k}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{k - 1}")
        if now == n:
            break
        n = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
