"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.llm.session import written

#: Far over what alternating steps need (about the logarithm of the longest path); beyond it something is wrong.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: (a, b) of an orderable type.

    Nodes that are in no edge between two different nodes are left out; they are components of their own.
    Repeated edges, either direction and null ends (ignored) are allowed. Each round is written to the shared
    folder, and a hub's neighbours meet in a join and a partial minimum, never as one list.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("p"), F.least("v", "m").alias("q")).where("p <> q")
        pairs = written(small.union(low.select("u", "m")).distinct().toDF("u", "v"), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    tops = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tops.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
