"""Finished runs as a stream: each is given out once, over restarts too."""

from tidewright.sources import run_stream, runs


def test_runs_are_given_out_once(spark, tmp_path):
    run_stream.register(spark)
    root, out, state = (str(tmp_path / x) for x in ("store", "out", "state"))
    cells = spark.createDataFrame([("u", 0, 0, 0, 1.0), ("u", 3, 0, 0, 2.0)], "param string, step_h int, row int, col int, v double")

    def drain():
        stream = spark.readStream.format("runs").load(root)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.run, r.cells, tuple(r.steps)) for r in spark.read.schema(run_stream.SCHEMA).parquet(out).collect())

    runs.write_run(cells, root, "2024010100")
    runs.write_run(cells, root, "2024010106")
    cells.write.partitionBy("param", "step_h").parquet(f"{root}/data/run=2024010112")  # not finished
    first = [("2024010100", 2, (0, 3)), ("2024010106", 2, (0, 3))]
    assert drain() == first
    assert drain() == first  # a restart repeats nothing
    runs.write_run(cells.where("step_h = 0"), root, "2024010112")
    assert drain() == [*first, ("2024010112", 1, (0,))]
    assert {r.run for r in runs.runs(spark, root).collect()} == {"2024010100", "2024010106", "2024010112"}


def test_an_empty_store(tmp_path):
    assert run_stream.finished(str(tmp_path)) == {}
