import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidewright.streaming import ingest


def written(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return path


def at(s):
    return dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)


def drained(spark, df, tmp_path, mode="append"):
    name = f"q{uuid.uuid4().hex}"
    return ingest.run_available(df, str(tmp_path / f"{name}-out"), str(tmp_path / name), mode).collect()


def test_windows_equal_a_batch(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string, v double"
    rows = [(at(i * 97), "ab"[i % 2], float(i)) for i in range(200)]
    path = written(spark, tmp_path, rows, schema)
    events = ingest.read_events(spark, path, spark.read.parquet(path).schema)
    got = drained(spark, ingest.windowed(events, ["kind"], "v", "10 minutes", "5 minutes"), tmp_path, "update")
    last = {}
    for r in got:
        last[r.start, r.kind] = max(last.get((r.start, r.kind), (0, 0.0, 0.0)), (r.n, r.total, r.most))
    batch = ingest.windowed(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")), ["kind"], "v", "10 minutes", "5 minutes").collect()
    assert last == {(r.start, r.kind): (r.n, r.total, r.most) for r in batch}


def test_views_split_by_gap(spark, tmp_path):
    schema = "ts timestamp_ntz, user string, zoom int, lon double, lat double"
    rows = [(at(0), "u", 5, 179.0, 10.0), (at(3), "u", 7, -179.0, 12.0), (at(20), "u", 4, 0.0, 0.0), (at(900), "w", 1, 1.0, 1.0)]
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.user, r.n, r.zoom, round(abs(r.lon)), r.lat) for r in ingest.views(batch, "user").collect())
    assert got == [("u", 1, 4, 0, 0.0), ("u", 2, 7, 180, 11.0), ("w", 1, 1, 1, 1.0)]


def test_refreshes_coalesce_and_runs_complete(spark, tmp_path):
    rows = [(at(1), "a", False, False), (at(2), "a", True, False), (at(50), "a", False, True), (at(70), "a", False, False)]
    batch = spark.createDataFrame(rows, "ts timestamp, source string, force boolean, owner boolean")
    got = sorted((r.force, r.owner, r.asked) for r in ingest.coalesced(batch, "source").collect())
    assert got == [(False, False, 1), (True, True, 3)]
    path = written(spark, tmp_path, [("r1", 1), ("r1", 2), ("r1", 3), ("r2", 1), ("r1", 3)], "run string, part long", 1)
    stream = spark.readStream.schema("run string, part long").parquet(path)
    assert [tuple(r) for r in drained(spark, ingest.complete_runs(stream, 3), tmp_path)] == [("r1", 3)]
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 5, "failed")], "job long, seq long, status string")
    assert sorted(tuple(r) for r in ingest.latest_status(log, "job", "seq", "status").collect()) == [(1, "done", 2), (2, "failed", 5)]
