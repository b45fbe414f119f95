"""Connected components by alternating large-star and small-star steps, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestframe.storage import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """Each u's least neighbour m, beside every neighbour v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of (a, b), of any type with an order. Edges may repeat; loops are dropped.

    The number of rounds grows with the logarithm of the longest chain squared at most; each round's
    edges are written to the shared folder, the round's before are dropped. A hub's edges meet its minimum by a join that Spark splits.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    state = None
    while True:
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, now = now, scratch.keep(small, "star")
        scratch.drop(before)
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (found["n"], found["h"]):
            break
        state = (found["n"], found["h"])
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = scratch.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    scratch.drop(now)
    return out
