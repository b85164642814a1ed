import json

import numpy as np

from pyspark.sql import functions as F

from tidewright.operators import tables


def test_managed_polar(spark):
    doc = {"kind": "polarTable", "schemaVersion": "1.0.0", "units": {"tws": "kn", "boatSpeed": "m/s"}, "axes": {"tws": [5, 10], "twa": [40, 90, 150]}, "values": {"boatSpeedMatrix": [[1, 2], [3, 4], [5, 6]]}}
    df = spark.createDataFrame([("a", json.dumps(doc)), ("b", "{}"), ("c", None)], "name string, doc string")
    got = {(r.polar, r.twa, round(r.tws * 3600 / 1852)): r.speed for r in tables.managed_polar(df, "name", "doc").collect()}
    assert got == {("a", 40.0, 5): 1.0, ("a", 40.0, 10): 2.0, ("a", 90.0, 5): 3.0, ("a", 90.0, 10): 4.0, ("a", 150.0, 5): 5.0, ("a", 150.0, 10): 6.0}


def test_coast_tiles_keep_area(spark):
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    xs, ys = (2.3 + 1.7 * np.cos(t)).tolist(), (-0.4 + 1.2 * np.sin(t)).tolist()
    parts = tables.coast_tiles(spark.createDataFrame([(1, xs, ys)], "ring int, xs array<double>, ys array<double>"), 0.5).collect()
    area = lambda x, y: abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    assert abs(sum(area(np.array(p.xs), np.array(p.ys)) for p in parts) - area(np.array(xs), np.array(ys))) < 1e-9
    for p in parts:
        assert min(p.xs) >= p.tx * 0.5 - 1e-9 and max(p.xs) <= (p.tx + 1) * 0.5 + 1e-9 and min(p.ys) >= p.ty * 0.5 - 1e-9 and max(p.ys) <= (p.ty + 1) * 0.5 + 1e-9


def test_supercover_as_a_table_function(spark):
    spark.udtf.register("supercover", tables.Supercover)
    spark.createDataFrame([(1, 0.5, 0.5, 2.5, 0.5)], "id int, x0 double, y0 double, x1 double, y1 double").createOrReplaceTempView("legs_t")
    got = spark.sql("SELECT id, c.col, c.row FROM legs_t, LATERAL supercover(x0, y0, x1, y1) c").collect()
    assert sorted((r.col, r.row) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_contours_close_around_a_hill(spark):
    from tidewright.operators import grids

    cells = [(r, c, float(10 - np.hypot(r - 6, c - 6))) for r in range(13) for c in range(13)]
    seg = grids.contour_segments(spark.createDataFrame(cells, "row int, col int, v double"), "v", 6.5).selectExpr("1 as k", "*")
    (line,) = grids.contour_lines(seg, ["k"]).collect()
    assert line.xs[0] == line.xs[-1] and line.ys[0] == line.ys[-1] and len(line.xs) == seg.count() + 1
    assert all(abs(np.hypot(x - 6, y - 6) - 3.5) < 0.25 for x, y in zip(line.xs, line.ys, strict=True))


def test_unknown_ends_and_equal_times(spark):
    from tidewright.functions.geodesy import segment_within
    from tidewright.operators.series import differences

    legs = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, None, 0.0), (3, 50.0, 0.0, None, None)], "id int, a double, b double, c double, d double")
    got = {r.id: r.near for r in legs.select("id", segment_within("a", "b", "c", "d", F.lit(0.0), F.lit(0.0), 1000.0).alias("near")).collect()}
    assert got == {1: True, 2: None, 3: None}
    steps = spark.createDataFrame([("k", 1, 1.0), ("k", 1, 3.0), ("k", 2, 2.0), ("k", 4, 8.0)], "key string, t int, v double")
    rates = [r["diff"] for r in differences(steps, ["key"], "t", "v", rate=True, ties=["v"]).orderBy("t", "v").collect()]
    assert rates == [None, 0.0, 3.0]
