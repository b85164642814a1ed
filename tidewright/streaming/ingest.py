"""Structured Streaming: ingest of observations, windows with late data, sessions, refresh coalescing, job event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", watermark: str = "10 minutes", files: int = 100) -> DataFrame:
    """A stream of Parquet files. Zoneless times become instants (in UTC), as a watermark needs them."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def windowed(events: DataFrame, keys: list[str], value: str, length: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """n, total and most by window and keys: tumbling, or sliding with `slide`. Rows behind the watermark are dropped by the engine."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "most")


def views(requests: DataFrame, user: str, ts: str = "ts", gap: str = "5 seconds") -> DataFrame:
    """Map views from bursts of tile requests (user, ts, zoom, lon, lat), split by a gap: deepest zoom and the circular-mean centre."""
    a = F.radians("lon")
    s = requests.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n"), F.max("zoom").alias("zoom"), F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))).alias("lon"), F.avg("lat").alias("lat"))
    return s.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "zoom", "lon", "lat")


def coalesced(refreshes: DataFrame, source: str, ts: str = "ts", within: str = "1 minute") -> DataFrame:
    """Waiting refreshes of a source become one: forced if any was, by an owner if any was."""
    return refreshes.groupBy(F.window(ts, within).alias("w"), source).agg(F.max("force").alias("force"), F.max("owner").alias("owner"), F.count("*").alias("asked")).select(source, F.col("w.start").alias("start"), "force", "owner", "asked")


def latest_status(log: DataFrame, job: str, seq: str, status: str) -> DataFrame:
    """Each job's status: the one of its last event."""
    return log.groupBy(job).agg(F.max_by(status, seq).alias(status), F.max(seq).alias(seq))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Works through all that is there and stops. Returns a table in the shared folder `path`: with mode "complete" the whole result as of
    the last batch, which each batch writes beside the others' (a batch that is repeated writes its own again); with "append" all rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    out = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if mode == "complete":
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out.drop("batch")


def append_to(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None):
    """A Parquet sink, each batch once; a run's rows appear together. Returns the started query."""
    out = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (out.partitionBy(*partition_by) if partition_by else out).start(path)


def complete_runs(parts: DataFrame, expected: int, run: str = "run", part: str = "part", checked: str = "ts") -> DataFrame:
    """Runs adopted once every expected part has come: the state of a run is the set of its parts."""

    def adopt(key, batches, state):
        import pandas as pd

        seen = set(state.get[0]) if state.exists else set()
        done = len(seen) >= expected
        for b in batches:
            seen |= set(b[part].tolist())
        state.update((sorted(seen),))
        if not done and len(seen) >= expected:
            yield pd.DataFrame({run: [key[0]], "parts": [len(seen)]})

    kind = parts.schema[part].dataType.simpleString()
    return parts.groupBy(run).applyInPandasWithState(adopt, f"{run} {parts.schema[run].dataType.simpleString()}, parts long", f"seen array<{kind}>", "append", "NoTimeout")
