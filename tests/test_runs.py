import json

from tidewright.functions import geodesy
from tidewright.operators.sampling import Geometry
from tidewright.sources import runs


def cells(spark, params=("wind", "tp"), steps=(0, 3, 9)):
    rows = [(p, s, r, c, float(s * 10 + r + c) if p == "tp" else (float("nan") if r == c else float(r * c))) for p in params for s in steps for r in range(20) for c in range(36)]
    return spark.createDataFrame(rows, "param string, step_h int, row int, col int, v double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_written_listed_windowed_and_pruned(spark, tmp_path):
    root = str(tmp_path / "store")
    assert runs.runs(spark, root).count() == 0
    for run in ("2024010100", "2024010106", "2024010112"):
        runs.write_run(cells(spark), root, run)
    got = {r.run: r for r in runs.runs(spark, root).collect()}
    assert len(got) == 3 and got["2024010100"].cells == 2 * 3 * 720 and got["2024010100"].steps == [0, 3, 9]
    pinned = spark.createDataFrame([("2024010100",)], "run string")
    assert {r.run for r in runs.to_prune(spark, root, 1).collect()} == {"2024010100", "2024010106"}
    assert {r.run for r in runs.to_prune(spark, root, 1, pinned).collect()} == {"2024010106"}
    grid = Geometry(-95.0, -180.0, 10.0, 10.0, 20, 36, wrap=True)
    box = runs.window(spark, root, "2024010106", ["wind"], [3], grid, (170.0, 0.0, -170.0, 20.0))
    found = box.collect()
    assert found and {r.step_h for r in found} == {3} and {r.col for r in found} <= {33, 34, 35, 0, 1, 2, 3} and 34 in {r.col for r in found} and 1 in {r.col for r in found}
    text = plan(box)
    assert "PartitionFilters: [param" in text or "PartitionFilters: [isnotnull(step_h" in text or "PartitionFilters: [" in text
    assert "GreaterThanOrEqual(row" in text and "LessThanOrEqual(row" in text
    assert all(r.v is None for r in found if r.row == r.col)


def test_steps_difference_and_energies_become_power(spark):
    df = spark.createDataFrame([("tp", 0, 0, 0, 1.0), ("tp", 0, 0, 6, 0.5), ("tp", 0, 0, 3, None), ("ssrd", 0, 0, 0, 0.0), ("ssrd", 0, 0, 2, 7200.0), ("str", 0, 0, 0, 0.0), ("str", 0, 0, 1, -3600.0), ("t", 0, 0, 0, 9.0)], "param string, row int, col int, step_h int, v double")
    got = sorted((r.param, r.step_h, r.v) for r in runs.stepwise(df).collect())
    assert got == [("ssrd", 2, 1.0), ("str", 1, -1.0), ("t", 0, 9.0), ("tp", 6, 0.0)]


def test_layouts_and_records(spark, tmp_path):
    by_time, by_place = ((100, 512, 512), (1, 512, 512)), ((100, 512, 512), (100, 16, 16))
    layouts = {"time": by_time, "place": by_place}
    assert runs.cheaper(layouts, [(5, 6), (0, 512), (0, 512)]) == "time" and runs.cheaper(layouts, [(0, 100), (7, 8), (7, 8)]) == "place"
    path = tmp_path / "r.json"
    path.write_text("\n".join([json.dumps({"name": "a", "n": 1}), "{broken", json.dumps({"name": "b", "n": 2})]))
    good, bad = runs.records(spark, str(path), "name string, n int")
    assert sorted(r.name for r in good.collect()) == ["a", "b"] and bad.count() == 1


def test_boxes():
    assert geodesy.bbox_meets((170, -10, -170, 10), (-175, 0, 0, 5)) and not geodesy.bbox_meets((0, 0, 10, 10), (20, 0, 30, 10))
    assert geodesy.bbox_union((170, -10, 175, 10), (-178, 0, -170, 20)) == (170, -10, -170, 20)
    assert geodesy.bbox_union((0, 0, 10, 10), (5, -5, 20, 5)) == (0, -5, 20, 10)
