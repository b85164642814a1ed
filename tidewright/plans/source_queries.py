"""Queries over files that the sinks write in the shared folder, and the sources read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.graphs import checkpoint_dir
from tidewright.plans.base import COLS, ROWS, collection, table
from tidewright.sources import readers, runs, tiles
from tidewright.sources.pushdown import where

QUERIES, ORACLES, query = collection()


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


TILED = """SELECT event_type AS layer, z, (event_id * 37 % (1 << z::INT))::BIGINT AS x, (event_id * 17 % (1 << z::INT))::BIGINT AS y, floor(epoch(ts) / 3600)::BIGINT AS hour,
  count(*) AS n, max(floor(value * 1000))::BIGINT AS most FROM events, range(2, 5) zooms(z) GROUP BY ALL"""


def _tiles(spark: SparkSession, sf_dir: str) -> str:
    """events as encoded tiles by type, zoom and hour; the folder they are in."""
    e, side = F.col("event_id"), F.expr("shiftleft(1, z)")
    cells = table(spark, sf_dir, "events").withColumn("z", F.explode(F.sequence(F.lit(2), F.lit(4))))
    cells = cells.groupBy(F.col("event_type").alias("layer"), "z", (e * 37 % side).alias("x"), (e * 17 % side).alias("y"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"))
    at = _folder(spark)
    readers.register(spark)
    tiles.write_tiles(cells.agg(F.count("*").alias("n"), F.max(F.floor(F.col("value") * 1000)).alias("most")).withColumn("body", F.to_json(F.struct("n", "most"))), at)
    return at


def _decoded(found: DataFrame) -> DataFrame:
    body = F.from_json("body", "n long, most long")
    return tiles.newest(found).select(F.col("layer"), F.col("z").cast("long").alias("z"), "x", "y", "hour", body["n"].alias("n"), body["most"].alias("most"))


@query(TILED)
def encoded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark.read.format("tiles").load(_tiles(spark, sf_dir)))


@query(f"SELECT * FROM ({TILED}) WHERE layer <> 'click' AND z = 3 AND x >= 4")
def tiles_asked_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of other zooms and layers are not opened, other columns not unpacked."""
    asked = where(("layer", "<>", "click"), ("z", "=", 3), ("x", ">=", 4))
    return _decoded(spark.read.format("tiles").option("where", asked).load(_tiles(spark, sf_dir)))


@query(f"""SELECT l_returnflag AS param, (l_linenumber * 3)::INT AS step_h, (l_partkey % {ROWS})::INT AS "row", (l_suppkey % {COLS})::INT AS col, max(floor(l_extendedprice))::DOUBLE AS v
  FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber <= 3 GROUP BY ALL""")
def run_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a run in the store, and what two parameters and the first steps of it hold, by way of its manifest."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("param"), (F.col("l_linenumber") * 3).cast("int").alias("step_h"), (F.col("l_partkey") % ROWS).cast("int").alias("row"), (F.col("l_suppkey") % COLS).cast("int").alias("col"))
    at, run = _folder(spark), "2024010100"
    runs.write_run(cells.agg(F.max(F.floor("l_extendedprice")).alias("v")), at, run)
    known = runs.runs(spark, at).where(F.col("run") == run).first()
    params, steps = ([x for x in known[k] if keep(x)] for k, keep in (("params", ("A", "R").__contains__), ("steps", lambda s: s <= 9)))
    found = runs.window(spark, at, run, params, steps)
    return found.select("param", F.col("step_h").cast("int").alias("step_h"), "row", "col", F.col("v").cast("double").alias("v"))


@query("""SELECT l_returnflag AS param, count(DISTINCT l_linenumber) AS steps, count(DISTINCT (l_linenumber, l_partkey % 40, l_suppkey % 50)) AS cells FROM lineitem GROUP BY 1""")
def run_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parameter as a run of its own, and the manifest's account of them: an interrupted run is not in it."""
    at = _folder(spark)
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("param"), (F.col("l_linenumber") * 3).cast("int").alias("step_h"), (F.col("l_partkey") % ROWS).alias("row"), (F.col("l_suppkey") % COLS).alias("col"), F.lit(1.0).alias("v")).distinct()
    for flag in ("A", "N", "R"):
        runs.write_run(cells.where(F.col("param") == flag), at, flag)
    cells.limit(0).write.parquet(f"{at}/data/run=lost")
    return runs.runs(spark, at).select(F.col("params")[0].alias("param"), F.size("steps").cast("long").alias("steps"), F.col("cells").cast("long").alias("cells"))
