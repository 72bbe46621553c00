"""Connected components of a distributed edge list, by alternating large-star and small-star contraction.

No node's neighbours are ever gathered: a star is a minimum for each node, joined back to its edges; the minima of hubs,
which a large part of all edges may have, are broadcast. Each round is written to shared storage, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.runtime import join_labels, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: bigint): root is the smallest node reachable. Loops and repeats do no harm."""
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_labels(both.where("v > u"), lowest, ["u"], 2 * state[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        rest = join_labels(large, lowest, ["a"], state[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(rest.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
