"""Marine views derived from the driver's tables, in Spark and in SQL with the same integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of the price grid.
ROWS, COLS = 40, 50


def collection() -> tuple[dict, dict, Callable]:
    """Queries and their SQL by name, and the decorator that adds one."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as positions with wind, current and waves."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        "value",
        ((u * 37 + e * 11) % 360 - 180).cast("double").alias("lon"),
        ((e * 17) % 161 - 80).cast("double").alias("lat"),
        (F.col("value") / 20.0).alias("wind"),
        ((e * 29) % 360).cast("double").alias("wind_from"),
        ((u % 25) / F.lit(10.0)).alias("cur"),
        ((e * 13) % 360).cast("double").alias("cur_to"),
        ((e % 70) / F.lit(10.0)).alias("swh"),
        (e % 12 + 3).cast("double").alias("mwp"),
        ((e * 7) % 360).cast("double").alias("mwd"),
        ((e * 19) % 360).cast("double").alias("course"),
    )


OBS = """obs AS (SELECT event_id, user_id, event_type, ts, value,
  ((user_id * 37 + event_id * 11) % 360 - 180)::DOUBLE AS lon, ((event_id * 17) % 161 - 80)::DOUBLE AS lat,
  value / 20.0::DOUBLE AS wind, ((event_id * 29) % 360)::DOUBLE AS wind_from,
  (user_id % 25)::DOUBLE / 10.0::DOUBLE AS cur, ((event_id * 13) % 360)::DOUBLE AS cur_to,
  (event_id % 70)::DOUBLE / 10.0::DOUBLE AS swh, (event_id % 12 + 3)::DOUBLE AS mwp,
  ((event_id * 7) % 360)::DOUBLE AS mwd, ((event_id * 19) % 360)::DOUBLE AS course FROM events)"""


def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a grid: mean price of each (row, col), to a hundredth."""
    mean = F.floor(F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")) / F.count("*") + 0.5) / 100.0
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % ROWS).cast("int").alias("row"), (F.col("l_suppkey") % COLS).cast("int").alias("col")).agg(mean.alias("v"))


GRID = f"""grid AS (SELECT (l_partkey % {ROWS})::INT AS "row", (l_suppkey % {COLS})::INT AS col,
  floor(sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::DOUBLE / count(*) + 0.5) / 100.0::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of events by hour, as a series of thousandths: h (hours since 2024-01-01) and v."""
    h = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long") - 473_352
    mean = F.floor(F.sum(F.floor(F.col("value") * 1000 + 0.5).cast("long")) / F.count("*") + 0.5) / 1000.0
    return table(spark, sf_dir, "events").groupBy(h.alias("h")).agg(mean.alias("v"))


HOURLY = """hourly AS (SELECT (floor(epoch(ts) / 3600)::BIGINT - 473352) AS h,
  floor(sum(floor(value * 1000 + 0.5)::BIGINT)::DOUBLE / count(*) + 0.5) / 1000.0::DOUBLE AS v FROM events GROUP BY 1)"""


def r(x: str, digits: int) -> str:
    """SQL for angles.rounded()."""
    return f"(floor(({x}) * 1e{digits}::DOUBLE + 0.5) / 1e{digits}::DOUBLE)"
