"""Queries over windows, sessions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.angles import rounded
from tidewright.operators.graphs import checkpoint_dir
from tidewright.plans.base import OBS, collection, observations, r, table
from tidewright.streaming import ingest, stateful

QUERIES, ORACLES, query = collection()


def _ntz(*names: str) -> list:
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS "start", time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total, max(floor(value)::BIGINT) AS most FROM events GROUP BY 1, 2, 3""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor("value").cast("long").alias("v"))
    return ingest.windowed(e, ["event_type"], "v", "6 hours").select(*_ntz("start", "end"), "event_type", "n", "total", "most")


@query("""WITH w AS (SELECT *, UNNEST([0, 6]) AS back FROM events), b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - back * INTERVAL 1 HOUR AS s, value FROM w)
  SELECT s AS "start", s + INTERVAL 12 HOUR AS "end", count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total, max(floor(value)::BIGINT) AS most FROM b GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("v"))
    return ingest.windowed(e, [], "v", "12 hours", "6 hours").select(*_ntz("start", "end"), "n", "total", "most")


@query(f"""WITH {OBS}, m AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, true)::INT AS new FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  q AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m)
  SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, max(event_id % 12)::INT AS zoom, {r('avg(lat)', 4)} AS lat FROM q GROUP BY user_id, s""")
def view_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumns({"ts": F.col("ts").cast("timestamp"), "zoom": (F.col("event_id") % 12).cast("int")})
    return ingest.views(o, "user_id", gap="2 hours").select("user_id", *_ntz("start", "end"), "n", "zoom", rounded("lat", 4).alias("lat"))


@query("""SELECT event_type AS source, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS "start", bool_or(user_id % 5 = 0) AS force, bool_or(user_id % 7 = 0) AS owner, count(*) AS asked FROM events GROUP BY 1, 2""")
def refresh_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), (F.col("user_id") % 5 == 0).alias("force"), (F.col("user_id") % 7 == 0).alias("owner"))
    return ingest.coalesced(e, "source", within="1 hour").select("source", *_ntz("start"), "force", "owner", "asked")


@query("""SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return ingest.latest_status(log, "user_id", "seq", "status")


@query("""SELECT event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1""")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files, worked through to its end."""
    source = f"{sf_dir}/events.parquet"
    name = f"totals_{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    stream = ingest.read_events(spark, f"{sf_dir}/events.parque[t]", schema)
    totals = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))
    return ingest.run_available(totals, f"{checkpoint_dir(spark)}/{name}-out", f"{checkpoint_dir(spark)}/{name}")


@query()
def refresh_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as refreshes asked for, each taking an hour: when one starts, and what it absorbed. Tests hold the machine against hand-made runs,
    and its stream against its table."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).alias("source"), (F.col("user_id") % 5 == 0).alias("force"), (F.col("event_id") % 7 == 0).alias("owner"))
    return stateful.over_table(e, ["source"], stateful.RefreshQueue(3_600_000)).select("source", *_ntz("start"), "force", "owner", "asked")


@query()
def map_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests for map tiles: bursts that a gap of two hours ends and a deeper zoom starts anew."""
    e, z = F.col("event_id"), (F.col("event_id") % 4 + 3).cast("int")
    side = F.shiftleft(F.lit(1), 3)
    tiles = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", z.alias("z"), (e * 37 % side).cast("int").alias("x"), (e * 17 % side).cast("int").alias("y"))
    got = stateful.over_table(tiles, ["user_id"], stateful.Views(7_200_000, 3))
    return got.select("user_id", *_ntz("until"), "z", "tiles", rounded("lon", 4).alias("lon"), rounded("lat", 4).alias("lat"))
