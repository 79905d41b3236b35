"""Connected components by alternating star contraction, in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every end of the edges (a, b); comp is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest of them; hot nodes meet in grouped minima (combined map-side) and in
    joins that Spark can split. No edge reaches the driver.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        new = scratch.put(small.where("a <> b").distinct())
        found = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
