"""Order-dependent operators on series in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differences(df: DataFrame, keys: list[str], order: str, value: str, rate: bool = False, clamp: bool = True, ties: list[str] | None = None) -> DataFrame:
    """`diff`: value less the previous present step's, over the span between them if `rate`; the first of each key is dropped."""
    w = Window.partitionBy(*keys).orderBy(order, *(ties or []))
    before, at = F.lag(value).over(w), F.lag(order).over(w)
    diff = F.col(value) - F.col("_before")
    diff = diff / F.nullif(F.col(order) - F.col("_at"), F.lit(0)) if rate else diff
    rows = df.where(F.col(value).isNotNull()).withColumns({"_before": before, "_at": at}).where(F.col("_at").isNotNull())
    return rows.withColumn("diff", F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))) if clamp else diff).drop("_before", "_at")


def extrema(df: DataFrame, keys: list[str], order: str, value: str, step: float = 1.0) -> DataFrame:
    """keys, order (middle of a plateau), value, kind: highs and lows of runs of equal values, none at an end or beside a gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    marks = df.withColumns({"_gap": F.coalesce(F.col(order) - F.lag(order).over(w) > step, F.lit(True)), "_same": F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))})
    runs = marks.withColumns({"_part": F.sum(F.col("_gap").cast("int")).over(w), "_run": F.sum((F.col("_gap") | ~F.col("_same")).cast("int")).over(w)})
    flat = runs.groupBy(*keys, "_part", "_run").agg(F.min(order).alias("_from"), F.max(order).alias("_to"), F.first(value).alias(value))
    by = Window.partitionBy(*keys, "_part").orderBy("_run")
    near = flat.withColumns({"_p": F.lag(value).over(by), "_n": F.lead(value).over(by)}).where("_p is not null and _n is not null")
    high, low = (F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n")), (F.col(value) < F.col("_p")) & (F.col(value) < F.col("_n"))
    return near.where(high | low).select(*keys, ((F.col("_from") + F.col("_to")) / 2.0).alias(order), value, F.when(high, "high").otherwise("low").alias("kind"))


def parabola(before: Column, here: Column, after: Column) -> tuple[Column, Column]:
    """Offset (within half a step; 0 where a sample is unknown) and height of the vertex through three samples."""
    bend = before - 2 * here + after
    dt = F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (before - after) / (2 * bend)))).otherwise(0.0)
    return dt, here - (before - after) * dt / 4


def tendency(df: DataFrame, keys: list[str], order: str, value: str, steady: float, step: float = 1.0) -> DataFrame:
    """`slope` (central, one-sided at ends and gaps) and `tendency`."""
    w = Window.partitionBy(*keys).orderBy(order)
    p, n = (F.when(F.abs(o(order).over(w) - F.col(order)) == step, o(value).over(w)) for o in (F.lag, F.lead))
    rows = df.withColumns({"_p": p, "_n": n})
    v = F.col(value)
    slope = F.when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), (F.col("_n") - F.col("_p")) / (2 * step)).when(F.col("_n").isNotNull(), (F.col("_n") - v) / step).when(F.col("_p").isNotNull(), (v - F.col("_p")) / step)
    return rows.withColumn("slope", slope).drop("_p", "_n").withColumn("tendency", F.when(F.abs("slope") < steady, "steady").when(F.col("slope") > 0, "rising").when(F.col("slope") < 0, "falling"))


def sample(points: DataFrame, df: DataFrame, keys: list[str], order: str, value: str, at: str, step: float = 1.0) -> DataFrame:
    """points with `sample`: linear between neighbouring samples, null in a gap and outside."""
    from tidewright.operators.timejoin import bracket

    met = bracket(points, df.where(F.col(value).isNotNull()), at, order, [value], keys)
    inside = (F.col("t0") <= F.col(at)) & (F.col(at) <= F.col("t1")) & (F.col("t1") - F.col("t0") <= step)
    return met.select(*points.columns, F.when(inside, F.col(f"{value}_0") + (F.col(f"{value}_1") - F.col(f"{value}_0")) * F.col("weight")).alias("sample"))


def collapse_runs(df: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """keys, run, kind, first, last, n: maximal runs of rows of one kind."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marks = df.withColumn("_new", F.coalesce(F.col(kind) != F.lag(kind).over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w))
    return marks.groupBy(*keys, "run", kind).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def resample(points: DataFrame, keys: list[str], t: str, values: list[str], step: int) -> DataFrame:
    """keys, t and values every `step` of an integer time from each key's first point, linear between points."""
    w = Window.partitionBy(*keys).orderBy(t)
    legs = points.withColumns({"_t1": F.lead(t).over(w), "_start": F.min(t).over(Window.partitionBy(*keys)), **{f"_{v}": F.lead(v).over(w) for v in values}})
    first = F.col("_start") + F.ceil((F.col(t) - F.col("_start")) / step).cast("long") * step
    last = F.coalesce(F.col("_t1") - 1, F.col(t))
    legs = legs.withColumn("_at", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    share = F.coalesce((F.col("_at") - F.col(t)) / (F.col("_t1") - F.col(t)), F.lit(0.0))
    return legs.select(*keys, F.col("_at").alias(t), *((F.col(v) + (F.coalesce(f"_{v}", v) - F.col(v)) * share).alias(v) for v in values))


def skip_after(df: DataFrame, keys: list[str], order: str, ended: Column) -> DataFrame:
    """`skipped`: whether an earlier row of the key has `ended`."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("skipped", F.coalesce(F.max(ended).over(w), F.lit(False)))


def prune_extrema(df: DataFrame, keys: list[str], order: str, value: str, kind: str, least: float) -> DataFrame:
    """Extrema (as from extrema()) without pairs closer than `least`: the closest adjacent high and low go (the first of equals), and what
    then meets of one kind merges into the more extreme, again and again. A key's extrema are worked through in one task, closest pairs
    first from a heap: one row a turn of tide."""
    import heapq

    import pandas as pd

    def prune(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, ignore_index=True)
        v, high, n = part[value].tolist(), (part[kind] == "high").tolist(), len(part)
        after, before, here = [*range(1, n), None], [None, *range(n - 1)], [True] * n
        gaps = [(abs(v[i] - v[i + 1]), i, i + 1) for i in range(n - 1)]
        heapq.heapify(gaps)

        def link(a: int | None, b: int | None) -> None:
            if a is not None:
                after[a] = b
            if b is not None:
                before[b] = a
            if a is not None and b is not None:
                heapq.heappush(gaps, (abs(v[a] - v[b]), a, b))

        while gaps and gaps[0][0] < least:
            _, i, j = heapq.heappop(gaps)
            if not (here[i] and here[j] and after[i] == j):
                continue
            here[i] = here[j] = False
            a, b = before[i], after[j]
            if a is None or b is None or high[a] != high[b]:
                link(a, b)
            elif (v[a] >= v[b]) if high[a] else (v[a] <= v[b]):
                here[b] = False
                link(a, after[b])
            else:
                here[a] = False
                link(before[a], b)
        return part[here]

    return df.groupBy(*keys).applyInPandas(prune, df.schema)
