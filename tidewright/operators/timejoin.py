"""Joins of observations to a time axis: bracketing (as-of on both sides), tolerance, containing intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(left: DataFrame, steps: DataFrame, at: str, step: str, values: list[str], by: list[str] | None = None, grace: float | None = None) -> DataFrame:
    """left with t0, t1, weight and, for each value v, v_0 and v_1: the steps around left.at and the share of the second.

    Before the first step and after the last both are that step; beyond `grace` of an end there is no match (null). The two
    tables are laid out together by time and each row takes the last step up to it and the first from it on: one shuffle by
    the keys, none of it quadratic. Time is cut into ranges, so that a key with many rows is many groups, and
    the steps at each range's edges are carried over. `by`: keys both tables share. Rows and steps with a null time or key meet none."""
    from pyspark.ml.feature import Bucketizer

    by = by or []
    keep = [F.col(c) for c in left.columns]
    extra = [c for c in left.columns if c not in by]
    pack = F.struct(F.col(step).alias("t"), *values)
    empty = F.lit(None).cast(steps.select(pack.alias("x")).schema["x"].dataType)
    rows = left.select(*by, F.col(at).cast("double").alias("_t"), F.struct(*extra).alias("_row"), empty.alias("_step"))
    marks = steps.select(*by, F.col(step).cast("double").alias("_t"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), pack.alias("_step")).dropna(subset=["_t", *by])
    n = max(64, 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = marks.agg(F.percentile_approx("_t", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    splits = [float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    both = Bucketizer(splits=splits, inputCol="_t", outputCol="_range", handleInvalid="keep").transform(rows.unionByName(marks))
    is_row, own = F.col("_row").isNotNull(), [*by, "_range"]
    before, after = Window.partitionBy(*own).orderBy(F.col("_t"), is_row), Window.partitionBy(*own).orderBy(F.col("_t").desc(), is_row)
    met = both.withColumns({"_p": F.last("_step", True).over(before), "_n": F.last("_step", True).over(after)}).where(is_row)
    # a row a range of each key, which takes the steps next to it from the ranges around
    ends = both.groupBy(*own).agg(F.min_by("_step", F.when(~is_row, F.col("_t"))).alias("_first"), F.max_by("_step", F.when(~is_row, F.col("_t"))).alias("_last"))
    order = Window.partitionBy(*by).orderBy("_range")
    carried = ends.select(*own, F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"), F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_to"))
    met = met.join(carried, own, "left")
    met = met.withColumns({"_p": F.coalesce("_p", "_from"), "_n": F.coalesce("_n", "_to")})
    met = met.withColumns({"_a": F.coalesce("_p", "_n"), "_b": F.coalesce("_n", "_p")}).select(*by, "_row.*", "_t", "_a", "_b")
    t0, t1 = F.col("_a.t").cast("double"), F.col("_b.t").cast("double")
    fits = F.col("_t").isNotNull() if grace is None else (F.col("_t") >= t0 - grace) & (F.col("_t") <= t1 + grace)
    held = lambda c: F.when(fits, c)
    out = {"t0": held(F.col("_a.t")), "t1": held(F.col("_b.t")), "weight": held(F.when(t1 > t0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_t") - t0) / (t1 - t0)))).otherwise(0.0))}
    out |= {f"{v}_{i}": held(F.col(f"_{s}.{v}")) for v in values for i, s in ((0, "a"), (1, "b"))}
    return met.withColumns(out).select(*keep, *out)


def blend(v0: str | Column, v1: str | Column, weight: str | Column) -> Column:
    """Linear in time; the first value where there is no second."""
    a, b, w = (F.col(x) if isinstance(x, str) else x for x in (v0, v1, weight))
    return F.when(b.isNull(), a).otherwise(a * (1 - w) + b * w)


def nearer(v0: str, v1: str, weight: str) -> Column:
    """For categories: the value of the nearer step."""
    return F.when(F.col(v1).isNull() | (F.col(weight) < 0.5), F.col(v0)).otherwise(F.col(v1))


def containing(left: DataFrame, intervals: DataFrame, at: str, end: str, length: str, values: list[str], by: list[str]) -> DataFrame:
    """left with the values of the interval (end - length, end] that holds left.at, by keys. Intervals of a key do not overlap."""
    ends = intervals.select(*by, F.col(end).alias("_end"), F.col(length).alias("_len"), *values)
    out = bracket(left, ends, at, "_end", ["_len", *values], by)
    inside = (F.col("t1") >= F.col(at)) & (F.col(at) > F.col("t1") - F.col("_len_1"))
    return out.select(*left.columns, *(F.when(inside, F.col(f"{v}_1")).alias(v) for v in values))
