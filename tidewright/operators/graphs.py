"""Graph operators over edges that stay distributed."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidewright-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint it is worked out once, and carries no constraints on, which grow from round to
    round in long loops."""
    at = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def connected(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component: the least id reachable. Every round a node takes the least label next to it, then its label's label."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    now = checkpointed(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most):
        near = both.join(now.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("_near"))
        least = now.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("component", "_near").alias("component"), F.col("component").alias("_was"))
        jump = least.join(least.select(F.col("id").alias("component"), F.col("component").alias("_next")), "component").select("id", F.col("_next").alias("component"), "_was")
        done = checkpointed(jump)
        now = done.select("id", "component")
        if done.where("component <> _was").isEmpty():
            return now
    raise RuntimeError("components did not settle")


def hops(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """id, dist: fewest edges from a source (breadth first), until none is new. A round joins the frontier alone to the edges."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    seen = frontier = checkpointed(sources.select("id").distinct().withColumn("dist", F.lit(0)))
    for d in count(1):
        reached = frontier.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = checkpointed(reached.withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if d % 20 == 0:
            seen = checkpointed(seen)


def back_trace(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """path, seq, id: parent pointers (id, parent) followed from each end to the last; seq counts from the end. Rounds double the
    reach; pointers that run in a circle have no last one and are an error."""
    known = checkpointed(ends.select(F.col("id").alias("path"), F.lit(0).alias("seq"), "id"))
    jump, reach = checkpointed(steps.select("id", "parent")), 1
    n = jump.count()
    while True:
        further = known.join(jump, "id").where("parent is not null").select("path", (F.col("seq") + reach).alias("seq"), F.col("parent").alias("id"))
        grown = checkpointed(known.unionByName(further))
        jump = checkpointed(jump.alias("x").join(jump.alias("y"), F.col("x.parent") == F.col("y.id"), "left").select(F.col("x.id"), F.col("y.parent")))
        if jump.where("parent is not null").isEmpty():
            return grown
        known, reach = grown, reach * 2
        if reach > n:
            raise RuntimeError("parents run in a circle")
