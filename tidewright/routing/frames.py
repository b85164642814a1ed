"""Kernels over DataFrames: one route, departure, member or tile a row, all in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.routing import isochrone, raster
from tidewright.routing.vessel import Polar, convex_hull

ROUTE = "route long, seq int, lon double, lat double, t double, sailing boolean, seconds double, metres double"


def route_requests(requests: DataFrame, polar_rows: list[tuple[float, float, float]], policy: isochrone.Policy = isochrone.Policy(), **search) -> DataFrame:
    """requests (route, lon0, lat0, lon1, lat1, depart, wind_ms, wind_from) to their routes' points. Each request is its own row
    and its own work: departures of a window and members of an ensemble are requests that differ in depart or wind."""
    polar = Polar.of_rows(polar_rows)

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                wind = lambda lon, lat, t, r=r: (np.full(np.shape(lon), r.wind_ms), np.full(np.shape(lon), r.wind_from))
                found = isochrone.route((r.lon0, r.lat0), (r.lon1, r.lat1), r.depart, polar, wind, policy, **search)
                if found is not None:
                    n = len(found["lon"])
                    out.append(pd.DataFrame({"route": r.route, "seq": np.arange(n, dtype="i4"), **{k: found[k] for k in ("lon", "lat", "t", "sailing")}, "seconds": found["seconds"], "metres": found["metres"]}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in ROUTE.split(", ")])

    return requests.select("route", "lon0", "lat0", "lon1", "lat1", F.col("depart").cast("double"), "wind_ms", "wind_from").mapInPandas(run, ROUTE)


def corridor(points: DataFrame, group: str, slices: int = 200) -> DataFrame:
    """points (group, route, seq, lon, lat): convex hulls of all routes' points by slice of equal progress. A hull sees a slice."""
    from pyspark.sql import Window

    from tidewright.functions.geodesy import haversine

    w = Window.partitionBy(group, "route").orderBy("seq")
    step = F.coalesce(haversine(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"), F.lit(0.0))
    run = points.withColumn("_step", step).withColumns({"_run": F.sum("_step").over(w), "_all": F.sum("_step").over(Window.partitionBy(group, "route"))})
    sliced = run.withColumn("slice", F.least(F.lit(slices - 1), F.floor(F.coalesce(F.try_divide(F.col("_run"), F.col("_all")), F.lit(0.0)) * slices)).cast("int"))

    def hull(key, part: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(part[["lon", "lat"]].to_numpy())
        return pd.DataFrame({group: key[0], "slice": key[1], "i": np.arange(len(h), dtype="i4"), "lon": h[:, 0], "lat": h[:, 1]})

    return sliced.select(group, "slice", "lon", "lat").distinct().groupBy(group, "slice").applyInPandas(hull, f"{group} {points.schema[group].dataType.simpleString()}, slice int, i int, lon double, lat double")


def simplified(points: DataFrame, tolerance_m: float) -> DataFrame:
    """points (route, seq, lon, lat) that Ramer-Douglas-Peucker keeps, route by route."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        p = part.sort_values("seq").reset_index(drop=True)
        return p.iloc[isochrone.simplify(p.lon, p.lat, tolerance_m)]

    kept = points.select("route", "seq", "lon", "lat")
    return kept.groupBy("route").applyInPandas(keep, kept.schema)


def tile_distance(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """cells (row, col, blocked) and `dist`, to the nearest blocked cell, in cells; exact up to `halo`, which longer ones are cut to.
    Tiles carry a halo of their neighbours' cells and are worked on side by side."""
    at = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    spread = cells.select("row", "col", "blocked", F.explode(at("row")).alias("tr")).select("*", F.explode(at("col")).alias("tc"))

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile - halo, key[1] * tile - halo
        n = tile + 2 * halo
        grid = np.zeros((n, n), bool)
        grid[part.row - r0, part.col - c0] = part.blocked
        dist = np.minimum(raster.distance_cells(grid), halo)
        own = part[(part.row // tile == key[0]) & (part.col // tile == key[1])]
        return pd.DataFrame({"row": own.row, "col": own.col, "dist": dist[own.row - r0, own.col - c0]})

    return spread.groupBy("tr", "tc").applyInPandas(run, "row int, col int, dist double")
