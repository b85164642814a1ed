"""Machines with state and timers: streams in shuffled batches against tables, and tables against hand-made runs."""

import datetime as dt
import random

import pytest

from tidewright.streaming import ingest
from tidewright.streaming.stateful import RefreshQueue, Series, Views, over_stream, over_table

BEGIN = dt.datetime(2024, 1, 1)


def at(s):
    return BEGIN + dt.timedelta(seconds=s)


def seconds(t):
    return (t - BEGIN).total_seconds()


def test_refreshes_absorb_what_waits(spark):
    asks = [("a", at(0), False, False), ("a", at(10), True, False), ("a", at(20), False, None), ("a", at(30), False, True), ("a", at(130), False, False), ("a", at(500), None, False), ("b", at(5), True, True), ("b", None, True, True)]
    df = spark.createDataFrame(asks, "source string, ts timestamp_ntz, force boolean, owner boolean").repartition(3)
    got = sorted((r.source, seconds(r.start), r.force, r.owner, r.asked) for r in over_table(df.withColumn("ts", df.ts.cast("timestamp")), ["source"], RefreshQueue(60_000)).withColumn("start", _ntz("start")).collect())
    assert got == [("a", 0, False, False, 1), ("a", 60, True, True, 3), ("a", 130, False, False, 1), ("a", 500, False, False, 1), ("b", 5, True, True, 1)]


def _ntz(c):
    from pyspark.sql import functions as F

    return F.col(c).cast("timestamp_ntz")


def test_series_go_on_when_one_ends(spark):
    log = [(1, at(0), "add", "x"), (1, at(1), "add", "y"), (1, at(2), "add", "z"), (1, at(3), "cancel", "y"), (1, at(9), "end", "x"), (1, at(20), "cancel", "z"), (1, at(30), "add", "w")]
    df = spark.createDataFrame(log, "series int, ts timestamp_ntz, kind string, item string")
    got = [(seconds(r.start), r.item, r.waiting) for r in over_table(df.withColumn("ts", _ntz("ts").cast("timestamp")), ["series"], Series()).withColumn("start", _ntz("start")).orderBy("start").collect()]
    assert got == [(0, "x", 0), (9, "z", 0), (30, "w", 0)]


def test_views_end_after_a_gap(spark):
    asked = [(7, at(0), 4, 0, 5), (7, at(3), 4, 15, 5), (7, at(6), 4, 0, 5), (7, at(20), 5, 1, 1), (7, at(21), 6, 2, 2), (7, at(22), 5, 9, 9), (7, at(40), 1, 0, 0), (7, at(41), None, 0, 0)]
    df = spark.createDataFrame(asked, "user int, ts timestamp_ntz, z int, x int, y int")
    rows = over_table(df.withColumn("ts", _ntz("ts").cast("timestamp")), ["user"], Views(5000, 2)).withColumn("until", _ntz("until")).orderBy("until").collect()
    assert [(seconds(r.until), r.z, r.tiles) for r in rows] == [(8.001, 4, 2), (26.001, 6, 1)]
    assert abs(abs(rows[0].lon) - 180) < 1e-9 and 40 < rows[0].lat < 56


@pytest.mark.parametrize("machine", [RefreshQueue(90_000), Views(30_000)])
def test_streams_equal_tables(spark, tmp_path, machine):
    rng = random.Random(5)
    times = rng.sample(range(3000), 150)
    if isinstance(machine, RefreshQueue):
        schema = "k string, ts timestamp_ntz, force boolean, owner boolean"
        rows = [(rng.choice("abc"), at(t), rng.random() < 0.2, rng.random() < 0.2) for t in times]
        last = [("end", at(90_000), False, False)]
    else:
        schema = "k string, ts timestamp_ntz, z int, x int, y int"
        rows = [(rng.choice("abc"), at(t), rng.randint(3, 5), rng.randint(0, 3), rng.randint(0, 3)) for t in times]
        last = [("end", at(90_000), 0, 0, 0)]
    rng.shuffle(rows)
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(str, over_table(whole.withColumn("ts", _ntz("ts").cast("timestamp")), ["k"], machine).collect()))
    path = str(tmp_path / "in")
    for i in range(3):  # any order within the hour that late events may come in
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(path)
    for k in range(3):  # later rows move the watermark on; what a timer asks for comes out with the next batch
        spark.createDataFrame([(last[0][0], last[0][1] + dt.timedelta(days=k), *last[0][2:])], schema).coalesce(1).write.mode("append").parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = over_stream(stream.withColumn("ts", _ntz("ts").cast("timestamp")), ["k"], machine, "1 hour")
        got = ingest.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"), "append").where("k <> 'end'").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(str, got))
    assert [x for x in got if x not in want] == [] and [x for x in want if x not in got] == [] and got == want and len(want) > 10
