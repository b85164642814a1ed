"""Forecast runs as Parquet: one folder a run, partitioned by parameter and step, with a manifest row that is written last."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.sampling import Geometry

#: Parameters whose values are sums since the start of a run, and those of them that are energies.
ACCUMULATED, ENERGY, SIGNED = ("tp", "sf", "ssrd", "strd", "str"), ("ssrd", "strd", "str"), ("str",)
_MANIFEST = "run string, params array<string>, steps array<int>, cells long, written timestamp"


def write_run(df: DataFrame, root: str, run: str) -> None:
    """df: param, step_h, row, col, v. Sorted by cell within each file, so that windows skip row groups. A run counts once its
    manifest row is there; a write that fails leaves none."""
    spark = df.sparkSession
    rows = df.select("param", "step_h", F.col("row").cast("int"), F.col("col").cast("int"), F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double")).cast("float").alias("v"))
    rows.repartition("param", "step_h").sortWithinPartitions("param", "step_h", "row", "col").write.mode("overwrite").partitionBy("param", "step_h").parquet(f"{root}/data/run={run}")
    done = spark.read.parquet(f"{root}/data/run={run}").agg(F.array_sort(F.collect_set("param")), F.array_sort(F.collect_set("step_h")), F.count("*")).first()
    spark.range(1).select(F.lit(run).alias("run"), F.array(*map(F.lit, done[0])).alias("params"), F.array(*map(F.lit, done[1])).alias("steps"), F.lit(done[2]).alias("cells"), F.current_timestamp().alias("written")).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The complete runs: the last manifest row of each."""
    try:
        rows = spark.read.parquet(f"{root}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], _MANIFEST)
        raise
    return rows.groupBy("run").agg(F.max_by(F.struct("params", "steps", "cells", "written"), "written").alias("m")).select("run", "m.*")


def to_prune(spark: SparkSession, root: str, keep: int, pinned: DataFrame | None = None) -> DataFrame:
    """Runs beyond the newest `keep` that nothing pins."""
    from tidewright.operators.coalescing import newest

    known = runs(spark, root).withColumn("_all", F.lit(0))
    old = known.join(newest(known, ["_all"], [F.desc("run")], keep).select("run"), "run", "left_anti")
    return (old.join(pinned, "run", "left_anti") if pinned is not None else old).select("run")


def window(spark: SparkSession, root: str, run: str, params: list[str], steps: list[int] | None = None, grid: Geometry | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A run's cells for parameters, steps and a box: partitions and row groups that cannot match are never read, for the filters are
    literals worked out from the box before planning."""
    df = spark.read.parquet(f"{root}/data/run={run}").where(F.col("param").isin(params))
    if steps is not None:
        df = df.where(F.col("step_h").isin(list(steps)))
    return df.where(grid.rows_cols(box)) if grid and box else df


def in_units(df: DataFrame) -> DataFrame:
    """Rates of precipitation in m/s (from kg/m²/s), the rest as they are."""
    return df.withColumn("v", F.when(F.col("param") == "tprate", F.col("v") / 1000.0).otherwise(F.col("v")))


def stepwise(df: DataFrame) -> DataFrame:
    """Accumulated parameters (param, row, col, step_h, v) as what came since the step before: energies as a mean power; all but
    net radiation no less than 0. Others pass."""
    from pyspark.sql import Window

    w = Window.partitionBy("param", "row", "col").orderBy("step_h")
    sums = F.col("param").isin(*ACCUMULATED)
    d = df.where(sums & F.col("v").isNotNull()).withColumns({"_v": F.lag("v").over(w), "_h": F.lag("step_h").over(w)}).where("_h is not null")
    diff = F.col("v").cast("double") - F.col("_v")
    v = F.when(F.col("param").isin(*ENERGY), diff / ((F.col("step_h") - F.col("_h")) * 3600)).otherwise(diff)
    v = F.when(F.col("param").isin(*SIGNED), v).otherwise(F.greatest(v, F.lit(0.0)))
    return d.select("param", "row", "col", "step_h", v.alias("v")).unionByName(df.where(~sums).select("param", "row", "col", "step_h", F.col("v").cast("double").alias("v")))


def layout_cost(shape: tuple[int, ...], chunks: tuple[int, ...], asked: list[tuple[int, int]], width: int = 4) -> float:
    """What reading index ranges of a chunked array costs: bytes of all chunks met, and 64 KiB a request."""
    met = math.prod(-(-hi // c) - lo // c for (lo, hi), c in zip(asked, chunks, strict=True))
    return met * (math.prod(chunks) * width + 65_536.0)


def cheaper(layouts: dict[str, tuple[tuple[int, ...], tuple[int, ...]]], asked: list[tuple[int, int]]) -> str:
    """The copy of an array (shape, chunks) that is cheaper to read; the first named wins a tie."""
    return min(layouts, key=lambda k: layout_cost(*layouts[k], asked))


def records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON records that read, and the text of those refused."""
    both = spark.read.schema(f"{schema}, _refused string").option("columnNameOfCorruptRecord", "_refused").option("mode", "PERMISSIVE").json(path).cache()
    return both.where("_refused is null").drop("_refused"), both.where("_refused is not null").select("_refused")
