"""Smaller relational operators: charts, corridors' hand-over, vias, documents, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def in_triangles(points: DataFrame, triangles: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """(key, tri) of points (x, y) inside triangles (tri, x0, y0, x1, y1, x2, y2), edges included: triangles are listed in the cells of
    their boxes, points meet those of their cell."""
    cell = lambda c: F.floor(c / size).cast("int")
    span = lambda a: F.sequence(cell(F.least(*(F.col(f"{a}{i}") for i in range(3)))), cell(F.greatest(*(F.col(f"{a}{i}") for i in range(3)))))
    t = triangles.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    p = points.withColumns({"_cx": cell(F.col("x")), "_cy": cell(F.col("y"))})
    side = lambda i, j: (F.col(f"x{j}") - F.col(f"x{i}")) * (F.col("y") - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (F.col("x") - F.col(f"x{i}"))
    a, b, c = side(0, 1), side(1, 2), side(2, 0)
    return p.join(t, ["_cx", "_cy"]).where(((a >= 0) & (b >= 0) & (c >= 0)) | ((a <= 0) & (b <= 0) & (c <= 0))).select(key, "tri").distinct()


def depth_check(samples: DataFrame, keys: list[str], depth: str, metres: str, need: float) -> DataFrame:
    """By leg: metres over known, unknown and too little depth, the least depth and where it is (first by `at`)."""
    d = F.col(depth)
    least = F.min(F.when(d.isNotNull(), F.struct(d.alias("d"), F.col("at"))))
    return samples.groupBy(*keys).agg(F.sum(F.when(d.isNotNull(), F.col(metres)).otherwise(0)).alias("known_m"), F.sum(F.when(d.isNull(), F.col(metres)).otherwise(0)).alias("unknown_m"), F.sum(F.when(d < need, F.col(metres)).otherwise(0)).alias("shallow_m"), least["d"].alias("least"), least["at"].alias("least_at"))


def handover(points: DataFrame, keys: list[str], along: str, narrow: Column, clear: Column, scan_m: float = 50_000.0) -> DataFrame:
    """Where a chart leg gives over to the open search: within scan_m, the first clear point after the last narrow one from which
    all points stay clear; else the last point scanned."""
    near = points.where(F.col(along) <= scan_m).withColumns({"_narrow": narrow, "_clear": clear})
    later = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marks = near.withColumns({"_stays": F.min("_clear").over(later), "_before": F.max("_narrow").over(later)})
    found = F.min(F.when(F.col("_stays") & ~F.col("_before"), F.col(along)))
    return marks.groupBy(*keys).agg(F.coalesce(found, F.max(along)).alias("handover"))


def merge_vias(own: DataFrame, found: DataFrame, keys: list[str], along: str, apart: float) -> DataFrame:
    """A route's own vias and those found for it, in order along it; a found one within `apart` of an own one is left out."""
    both = own.withColumn("_own", F.lit(True)).unionByName(found.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(along)
    mine = F.when(F.col("_own"), F.col(along))
    marks = both.withColumns({"_p": F.last(mine, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.first(mine, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    close = (F.col(along) - F.col("_p") < apart) | (F.col("_n") - F.col(along) < apart)
    return marks.where(F.col("_own") | ~F.coalesce(close, F.lit(False))).withColumn("seq", F.row_number().over(w)).withColumn("own", F.col("_own")).drop("_p", "_n", "_own")


def aligned_steps(starts: Column, ends: Column, first: Column, last: Column, step: int) -> Column:
    """Multiples of `step` hours that cover [starts, ends], as far as the axis goes."""
    low, high = F.floor(starts / step) * step, F.ceil(ends / step) * step
    low, high = F.greatest(low, F.ceil(first / step) * step).cast("long"), F.least(high, F.floor(last / step) * step).cast("long")
    return F.when(low <= high, F.sequence(low, high, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


POLAR_JSON = "kind string, schemaVersion string, units struct<tws:string,twa:string,boatSpeed:string>, axes struct<tws:array<double>,twa:array<double>>, values struct<boatSpeedMatrix:array<array<double>>>"


def managed_polar(documents: DataFrame, name: str, text: str) -> DataFrame:
    """Rows (polar, twa, tws, speed) in SI of JSON polars; the matrix runs by twa, then tws."""
    d = documents.select(F.col(name).alias("polar"), F.from_json(text, POLAR_JSON).alias("d")).where("d.axes is not null")
    knot = 1852.0 / 3600.0
    factor = lambda unit: F.when(F.lower(F.coalesce(unit, F.lit("kn"))).isin("kn", "kt", "knots"), knot).otherwise(1.0)
    # matrix, axes and units are zipped into rows before they are exploded: one generator, on one column
    cells = F.flatten(F.transform("d.values.boatSpeedMatrix", lambda row, i: F.transform(row, lambda v, j: F.struct(F.get("d.axes.twa", i).alias("twa"), (F.get("d.axes.tws", j) * factor(F.col("d.units.tws"))).alias("tws"), (v * factor(F.col("d.units.boatSpeed"))).alias("speed")))))
    return d.select("polar", cells.alias("cells")).select("polar", F.inline("cells"))


def si_text(text: Column, units: dict[str, str]) -> Column:
    """{category:value} tokens as the value and its SI unit."""
    for category, unit in units.items():
        text = F.regexp_replace(text, r"\{" + category + r":(-?[0-9.]+)\}", f"$1 {unit}")
    return text


def weather_items(rows: DataFrame) -> DataFrame:
    """Forecast rows as nested records: radians and ratios, as instruments have them."""
    wind = F.struct(F.col("wind_ms").alias("speedTrue"), F.radians("wind_from").alias("directionTrue"))
    water = F.struct(F.col("swh").alias("waveSignificantHeight"), F.col("mwp").alias("wavePeriod"), F.radians("mwd").alias("waveDirection"))
    return rows.select("event_id", F.to_json(F.struct(wind.alias("wind"), water.alias("water"))).alias("item"))


def store_totals(files: DataFrame) -> DataFrame:
    """By layer: files, bytes, hits and misses, and over all of them."""
    return files.rollup("layer").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.col("hit").cast("int")).alias("hits"), F.sum((~F.col("hit")).cast("int")).alias("misses"))


def end_note(state: Column, left: Column, name: Column) -> tuple[Column, Column]:
    """How loudly, and in what words, the end of a job or a set is told."""
    text = F.when(state == "failed", F.concat(name, F.lit(" failed"))).when(left > 0, F.concat(name, F.lit(": "), left.cast("string"), F.lit(" left"))).otherwise(F.concat(name, F.lit(" is ready")))
    return F.when(state == "failed", "alert").otherwise("normal"), text


@udtf(returnType="col: int, row: int")
class Supercover:
    """SELECT … FROM legs, LATERAL supercover(x0, y0, x1, y1): every cell a leg touches."""

    def eval(self, x0: float, y0: float, x1: float, y1: float):
        from tidewright.routing.raster import supercover

        yield from supercover(x0, y0, x1, y1)


def leg_cells(legs: DataFrame, key: str, size: float) -> DataFrame:
    """key, col, row: the cells of a lattice that legs (x0, y0, x1, y1) touch."""
    import pyarrow as pa

    def run(batches):
        from tidewright.routing.raster import supercover

        for b in batches:
            found = [supercover(*(v / size for v in xy)) for xy in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            which = pa.array([i for i, cells in enumerate(found) for _ in cells], pa.int32())
            flat = [c for cells in found for c in cells]
            yield pa.record_batch([b.column(0).take(which), pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32())], names=[key, "col", "row"])

    return legs.select(key, "x0", "y0", "x1", "y1").mapInArrow(run, f"{key} {legs.schema[key].dataType.simpleString()}, col int, row int").distinct()


def coast_tiles(rings: DataFrame, tile: float) -> DataFrame:
    """rings (ring, xs, ys) cut to tiles: ring, tx, ty, xs, ys. A ring is halved until each part lies in one tile; work is by ring."""
    import numpy as np
    import pandas as pd

    def cut(batches):
        from tidewright.routing.raster import clip_ring

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                todo = [np.stack([np.asarray(r.xs, float), np.asarray(r.ys, float)], 1)]
                while todo:
                    ring = todo.pop()
                    if len(ring) < 3:
                        continue
                    low, high = np.floor(ring.min(0) / tile + 1e-12), np.ceil(ring.max(0) / tile - 1e-12) - 1
                    axis = int(np.argmax(high - low))
                    if high[axis] > low[axis]:
                        at = (np.floor((low[axis] + high[axis]) / 2) + 1) * tile
                        todo += [clip_ring(ring, axis, at, keep) for keep in (True, False)]
                    else:
                        out.append((r.ring, int(low[0]), int(low[1]), ring[:, 0].tolist(), ring[:, 1].tolist()))
            yield pd.DataFrame(out, columns=["ring", "tx", "ty", "xs", "ys"])

    return rings.select("ring", "xs", "ys").mapInPandas(cut, f"ring {rings.schema['ring'].dataType.simpleString()}, tx int, ty int, xs array<double>, ys array<double>")
