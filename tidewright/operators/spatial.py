"""Spatial joins. Candidates meet in cells of a lattice, by equality; an exact test follows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.angles import wrap_lon
from tidewright.functions.geodesy import RADIUS, haversine


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def within_circles(points: DataFrame, circles: DataFrame, most_m: float, size: float = 5.0) -> DataFrame:
    """points joined to the circles (c_lon, c_lat, radius_m) that hold them; no radius may exceed most_m. Circles are listed in
    the cells they may touch, rows of latitude by rows of longitude, over the antimeridian and around the poles."""
    reach = math.degrees(most_m / RADIUS)
    lat_cells = F.sequence(_cell(F.greatest(F.lit(-90.0), F.col("c_lat") - reach), size), _cell(F.least(F.lit(90.0), F.col("c_lat") + reach), size))
    c = circles.withColumn("_cy", F.explode(lat_cells))
    far = F.greatest(F.abs(F.col("_cy") * size), F.abs((F.col("_cy") + 1) * size), F.abs("c_lat") + reach)
    around = F.when(far >= 89, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(min(reach, 90.0))) / F.cos(F.radians(F.least(far, F.lit(89.0))))))) + 1e-6)
    n = int(round(360 / size))
    cols = F.array_distinct(F.transform(F.sequence(_cell(F.col("c_lon") - F.col("_around") + 180, size), _cell(F.col("c_lon") + F.col("_around") + 180, size)), lambda x: F.pmod(x, F.lit(n))))
    c = c.withColumn("_around", around).withColumn("_cx", F.explode(cols)).drop("_around")
    p = points.withColumns({"_cy": _cell(F.col("lat"), size), "_cx": F.pmod(_cell(wrap_lon("lon") + 180, size), F.lit(n))})
    return p.join(c, ["_cx", "_cy"]).where(haversine("lon", "lat", "c_lon", "c_lat") <= F.col("radius_m")).drop("_cx", "_cy")


def in_polygons(points: DataFrame, edges: DataFrame, key: str, size: float | None = None) -> DataFrame:
    """(key, poly) for points in polygons by even-odd crossings. edges: poly, x0, y0, x1, y1, rings of shells and holes alike.
    Edges are listed by the bands of latitude they cross; a point meets its band's edges, not all. Bands are as high as an edge on the
    mean (at most 1 degree) unless a size is given: with finer coastlines there are more bands, not more edges in each."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    if size is None:
        size = min(1.0, max(1e-4, edges.where("y0 <> y1").agg(F.avg(high - low)).first()[0] or 1.0))
    banded = edges.where("y0 <> y1").withColumn("_band", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    met = points.withColumn("_band", _cell(F.col("lat"), size)).join(banded, "_band")
    crosses = ((F.col("y0") > F.col("lat")) != (F.col("y1") > F.col("lat"))) & (F.col("lon") < (F.col("x1") - F.col("x0")) * (F.col("lat") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    return met.where(F.col("lon") < F.greatest("x0", "x1")).where(crosses).groupBy(key, "poly").agg((F.count("*") % 2 == 1).alias("_in")).where("_in").select(key, "poly")


def legs_touching(legs: DataFrame, edges: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """The keys of legs (a_lon, a_lat, b_lon, b_lat) that touch an edge (x0, y0, x1, y1). Both are listed in the cells of their
    bounding boxes; longer legs are to be cut first."""
    def cells(d: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        span = lambda a, b: F.sequence(_cell(F.least(a, b), size), _cell(F.greatest(a, b), size))
        return d.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))

    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    a, b, c, d = ("a_lon", "a_lat"), ("b_lon", "b_lat"), ("x0", "y0"), ("x1", "y1")
    d1, d2, d3, d4 = side(*c, *d, *a), side(*c, *d, *b), side(*a, *b, *c), side(*a, *b, *d)
    on = lambda p, q, r_, o: (o == 0) & F.col(r_[0]).between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & F.col(r_[1]).between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    hit = ((d1 * d2 < 0) & (d3 * d4 < 0)) | on(c, d, a, d1) | on(c, d, b, d2) | on(a, b, c, d3) | on(a, b, d, d4)
    met = cells(legs, "a_lon", "a_lat", "b_lon", "b_lat").join(cells(edges, "x0", "y0", "x1", "y1"), ["_cx", "_cy"])
    return met.where(hit).select(key).distinct()


def lattice(box: tuple[float, float, float, float], res: float, most: int) -> tuple[list[float], float]:
    """Counts along the axes and spacing of the lattice of multiples of res inside a box, res doubled until at most `most` points."""
    w, s, e, n = box
    while True:
        nx, ny = math.floor(e / res + 1e-9) - math.ceil(w / res - 1e-9) + 1, math.floor(n / res + 1e-9) - math.ceil(s / res - 1e-9) + 1
        if nx * ny <= most:
            return [max(nx, 0), max(ny, 0)], res
        res *= 2


def lattice_points(spark, box: tuple[float, float, float, float], res: float, most: int = 40_000) -> DataFrame:
    """lon, lat of lattice()'s points: at most `most` rows."""
    (nx, ny), res = lattice(box, res, most)
    i0, j0 = math.ceil(box[0] / res - 1e-9), math.ceil(box[1] / res - 1e-9)
    return spark.range(nx * ny).select(((F.col("id") % max(nx, 1) + i0) * F.lit(res)).alias("lon"), ((F.floor(F.col("id") / max(nx, 1)) + j0) * F.lit(res)).alias("lat"))
