"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b long), component being the smallest node reached.

    Each round points the larger neighbours of a node at the least node around it, then does the same
    with the smaller ones; the number of rounds grows with the logarithm of the longest chain. Every
    step is an aggregation that combines map-side and a join with one row per node, and rounds end in
    stored files, so a lost executor costs at most one round.
    """
    small, large = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(edges.select(large.alias("a"), small.alias("b")).filter("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        far = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        near = far.groupBy("a").agg(F.min("b").alias("m"))
        hops = far.join(near, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        following = stored(hops.union(near.select("a", F.col("m").alias("b"))).distinct(), "edges")
        new_state = _state(following)
        edges = following
        if new_state == state:
            break
        state = new_state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
