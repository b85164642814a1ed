"""Connected components by alternating large and small stars, over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: every larger neighbour of a node moves to its least neighbour; small: every smaller one, and the node."""
    sides = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = sides.join(least, "a")
    if small:
        moved = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge. edges: two integer columns a, b; loops,
    repeats and either direction are allowed, rows with a null are ignored. Every round is written to the shared folder."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)")))
    was = now.agg(mark).first()[0]
    for _ in range(most_rounds):
        if not was[0]:
            break
        now = written(_star(_star(now, False), True), "edges")
        if (mark_now := now.agg(mark).first()[0]) == was:
            break
        was = mark_now
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
