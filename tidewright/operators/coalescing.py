"""Several sources of one quantity: priority, layering, freshness, retention, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.angles import clamp


def by_priority(df: DataFrame, keys: list[str], priority: str, name: str, values: list[str], present: Column) -> DataFrame:
    """keys, values and `source`: those of the highest priority among present rows; ties by name. One aggregate, no join."""
    pick = F.max_by(F.struct(*values, F.col(name).alias("source")), F.struct(F.col(priority), F.col(name)))
    return df.where(present).groupBy(*keys).agg(pick.alias("_p")).select(*keys, "_p.*")


def layered(base: Column, layers: list[tuple[Column, Column]]) -> Column:
    """base, with each (value, weight) blended over what lies below, in the given order; a missing layer changes nothing, a missing base stays missing."""
    return reduce(lambda below, layer: below * (1 - F.when(layer[0].isNull(), 0.0).otherwise(F.coalesce(layer[1], F.lit(0.0)))) + F.coalesce(layer[0], F.lit(0.0)) * F.when(layer[0].isNull(), 0.0).otherwise(F.coalesce(layer[1], F.lit(0.0))), layers, base)


def edge_weight(cells_from_edge: Column, hours_left: Column, edge: float = 5.0, hours: float = 3.0) -> Column:
    """A layer's weight: full inside, falling to 0 at its edge and at its end; null where either is unknown."""
    return clamp(cells_from_edge / edge, 0, 1) * clamp(hours_left / hours, 0, 1)


def shares(df: DataFrame, name: str) -> DataFrame:
    """name and its share of all rows: totals of a name, then of all names."""
    counts = df.groupBy(name).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).select(name, "n", (F.col("n") / F.col("_all")).alias("share"))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of each key in an order: retention, and the newest run of each source."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def trim_to_size(df: DataFrame, keys: list[str], order: list[Column], size: str, cap: float) -> DataFrame:
    """What stays of each key: all of it while within the cap; beyond it, the most recently used up to 90 % of the cap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = df.withColumns({"_run": F.sum(size).over(w), "_all": F.sum(size).over(Window.partitionBy(*keys))})
    return sized.where((F.col("_all") <= cap) | (F.col("_run") <= 0.9 * cap)).drop("_run", "_all")


def complete(present: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """The keys that have every row of `expected`, a small dimension (relational division)."""
    on = expected.columns
    need = expected.distinct()
    met = present.select(*keys, *on).distinct().join(need, on, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
    return met.crossJoin(need.agg(F.count("*").alias("_need"))).where("_n = _need").select(*keys)


def stale(present: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are no longer current."""
    return present.join(current, keys, "left_anti")
