"""Composite queries over gridded fields: conditions, arrows, tides, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import libm
from tidewright.functions import meteo as M
from tidewright.functions.angles import angle_between, rounded, wrap_lon
from tidewright.functions.geodesy import RADIUS, haversine, segment_within
from tidewright.operators import sampling as S


def conditions(rows: DataFrame, lat: str = "lat") -> DataFrame:
    """rows with u, v (wind), cu, cv (current, 0,0 for none), swh, mwp, mwd, t_k, dew_k, msl_pa as the columns a reader is shown."""
    wind, current = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), F.sqrt(F.col("cu") * F.col("cu") + F.col("cv") * F.col("cv"))
    none = (F.col("cu") == 0) & (F.col("cv") == 0)
    r = rows.withColumns({"wind_ms": wind, "wind_from": M.wind_from("u", "v", libm.atan2), "current_ms": F.when(~none, current), "current_to": F.when(~none, M.current_to("cu", "cv", libm.atan2)), "rh": M.relative_humidity("t_k", "dew_k"), "t_c": F.col("t_k") - 273.15})
    feels, basis = M.feels_like("t_c", "wind_ms", "rh")
    r = r.withColumns({"beaufort": M.beaufort("wind_ms"), "douglas": M.douglas("swh"), "sea_index": M.sea_state_index("wind_ms", "wind_from", "current_ms", "current_to", "swh", "mwp", "mwd", libm.cos), "partial": F.col("swh").isNull() | F.col("mwp").isNull() | F.col("mwd").isNull(), "feels_c": rounded(feels, 1), "feels_basis": basis, "hpa": rounded(F.col("msl_pa") / 100, 1)})
    shown = {"wind_ms": 2, "wind_from": 0, "current_ms": 3, "current_to": 0, "rh": 3, "t_c": 1}
    return r.withColumns({k: rounded(k, n) for k, n in shown.items()}).withColumn("band", M.band("sea_index")).drop("u", "v", "cu", "cv")


def wind_points(rows: DataFrame) -> DataFrame:
    """lon, lat, speed and direction, where there is wind."""
    return rows.where("u is not null and v is not null").select("lon", "lat", rounded(F.hypot("u", "v"), 2).alias("speed"), rounded(M.wind_from("u", "v"), 1).alias("from"))


def current_points(rows: DataFrame, least: float = 0.005) -> DataFrame:
    """lon, lat, speed and direction at sea, where the current is worth an arrow."""
    speed = F.hypot("cu", "cv")
    return rows.where((speed >= least) & ~F.col("land")).select("lon", "lat", rounded(speed, 3).alias("speed"), rounded(M.current_to("cu", "cv"), 1).alias("to"))


def sea_points(rows: DataFrame) -> DataFrame:
    """lon, lat, index, band, and how the current meets the waves."""
    speed = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    r = rows.where("u is not null and not land").withColumns({"_wind": speed("u", "v"), "_from": M.wind_from("u", "v", libm.atan2), "_cur": speed("cu", "cv"), "_to": M.current_to("cu", "cv", libm.atan2)})
    along = F.col("_cur") * libm.cos(F.radians(angle_between(F.col("mwd") + 180.0, "_to")))
    r = r.withColumns({"index": M.sea_state_index("_wind", "_from", "_cur", "_to", "swh", "mwp", "mwd", libm.cos), "_along": along})
    return r.select("lon", "lat", "index", M.band("index").alias("band"), M.relation("_along").alias("relation"))


def tide_series(hours: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """hours (tide, total) with `surge` and `level`: the offset of the means is taken out over all hours that have both."""
    shift = hours.where("tide is not null and total is not null").groupBy(*keys).agg(F.avg(F.col("total") - F.col("tide")).alias("shift"), F.count("*").alias("samples"))
    met = hours.join(shift, keys, "left").withColumn("surge", M.surge("tide", "total", "shift"))
    return met.select(*keys, t, "tide", "surge", (F.col("tide") + F.col("surge")).alias("level"), "samples")


def bilinear_filled(points: DataFrame, field: DataFrame, g: S.Geometry, radius: int = 2) -> DataFrame:
    """Bilinear over a field whose missing cells are filled from near ones; `filled` where that made a difference."""
    full = S.fill_idw(field, radius, around=g.n_lon if g.wrap else None)
    value = S.bilinear_present(points, full.select("row", "col", "v"), g)
    used = S.bilinear_present(value, full.select("row", "col", F.col("filled").cast("double").alias("v")), g, out="_f")
    return used.select(*points.columns, "sample", (F.coalesce("_f", F.lit(0.0)) > 0).alias("filled"))


# Mean longitudes (degrees at 1899-12-31 12:00 UTC, and per day) of moon, sun, lunar perigee, lunar node and solar perigee,
# and Doodson numbers (tau, s, h, p, N', ps) with a phase in degrees, of the main constituents.
LONGITUDES = {"s": (270.434164, 13.1763965268), "h": (279.696678, 0.9856473354), "p": (334.329556, 0.1114040803), "n": (-259.183275, 0.0529539222), "ps": (281.220844, 0.0000470684)}
DOODSON = {
    "M2": (2, 0, 0, 0, 0, 0, 0), "S2": (2, 2, -2, 0, 0, 0, 0), "N2": (2, -1, 0, 1, 0, 0, 0), "K2": (2, 2, 0, 0, 0, 0, 0), "K1": (1, 1, 0, 0, 0, 0, 90),
    "O1": (1, -1, 0, 0, 0, 0, 270), "P1": (1, 1, -2, 0, 0, 0, 270), "Q1": (1, -2, 0, 1, 0, 0, 270), "MF": (0, 2, 0, 0, 0, 0, 0), "MM": (0, 1, 0, -1, 0, 0, 0), "M4": (4, 0, 0, 0, 0, 0, 0),
}


# Nodal factor f = a + b cos N and correction u = c sin N (degrees), N the longitude of the moon's ascending node.
NODAL = {"M2": (1.0, -0.037, -2.1), "N2": (1.0, -0.037, -2.1), "K2": (1.024, 0.286, -17.7), "K1": (1.006, 0.115, -8.9), "O1": (1.009, 0.187, 10.8), "Q1": (1.009, 0.187, 10.8), "MF": (1.043, 0.414, -23.7), "MM": (1.0, -0.130, 0.0)}


def nodal(name: str, node: Column) -> tuple[Column, Column]:
    """f and u of a constituent; those without an entry have 1 and 0, overtides the powers of their base."""
    if name == "M4":
        f, u = nodal("M2", node)
        return f * f, 2 * u
    a, b, c = NODAL.get(name, (1.0, 0.0, 0.0))
    return a + b * F.cos(F.radians(node)), c * F.sin(F.radians(node))


def tidal_arguments(times: DataFrame, mjd: str = "mjd", names: list[str] | None = None) -> DataFrame:
    """times with `constituent`, `arg` (the equilibrium argument in degrees, [0, 360)), and the nodal `f` and `u`: a height is the sum of
    f * amplitude * cos(arg + u - phase)."""
    day = F.col(mjd) - 15019.5
    at = {k: F.lit(a) + b * day for k, (a, b) in LONGITUDES.items()}
    tau = 15.0 * 24.0 * F.pmod(F.col(mjd), F.lit(1.0)) - at["s"] + at["h"]
    rows = []
    for name in names or list(DOODSON):
        a, b, c, d, e, f, phase = DOODSON[name]
        arg = a * tau + (b * at["s"] + c * at["h"] + d * at["p"] + e * at["n"] + f * at["ps"]) + float(phase)
        rows.append(F.struct(F.lit(name).alias("constituent"), (F.pmod(arg, F.lit(360.0)) + 0.0).alias("arg"), *(x.alias(k) for k, x in zip("fu", nodal(name, -at["n"]), strict=True))))
    return times.select("*", F.inline(F.array(*rows)))


def tiles_of_box(spark: SparkSession, box: tuple[float, float, float, float], z: int) -> DataFrame:
    """x, y of the Web Mercator tiles over a box, across the antimeridian too."""
    n = 1 << z
    y_of = lambda lat: min(n - 1, max(0, int((1 - math.log(math.tan(math.pi / 4 + math.radians(max(-85.05112878, min(85.05112878, lat))) / 2)) / math.pi) / 2 * n)))
    x0, x1 = (math.floor((lon + 180) / 360 * n) for lon in (box[0], box[2] if box[0] <= box[2] else box[2] + 360))
    xs = spark.range(x0, x1 + 1).select(F.pmod(F.col("id"), F.lit(n)).cast("int").alias("x")).distinct()
    return xs.withColumn("y", F.explode(F.sequence(F.lit(y_of(box[3])), F.lit(y_of(box[1])))))


def zoom_for(res: float, spacing_px: int = 64, most: int = 12) -> int:
    """The zoom whose samples, so many a tile, are nearest to a spacing in degrees."""
    return max(0, min(most, round(math.log2(360.0 / (res * spacing_px)))))


def nearest_tiles(tiles: DataFrame, x: float, y: float, z: int) -> DataFrame:
    """Tiles in order of distance, around the globe."""
    n = float(1 << z)
    dx = F.abs(F.col("x") + 0.5 - x)
    d = F.pow(F.least(dx, n - dx), 2) + F.pow(F.col("y") + 0.5 - y, 2)
    return tiles.withColumn("d", d).orderBy("d", "y", "x")


def join_tiles(tiles: DataFrame, box: tuple[float, float, float, float], res: float) -> DataFrame:
    """lon, lat, v of lattice points inside a box, from tiles that hold them; shared edges once, the tile first by z, x, y."""
    i, j = F.floor(F.col("lon") / res + 0.5), F.floor(F.col("lat") / res + 0.5)
    inside = tiles.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])).withColumns({"i": i, "j": j})
    return inside.groupBy("i", "j").agg(F.min(F.struct("z", "x", "y", "v")).alias("m")).select((F.col("i") * res).alias("lon"), (F.col("j") * res).alias("lat"), "m.v")


def shore_within(points: DataFrame, edges: DataFrame, key: str, metres: float, size: float = 1.0) -> DataFrame:
    """Keys of points (lon, lat) within so many metres of a shore's edges (x0, y0, x1, y1: great circles of a few degrees at most, over the
    date line the shorter way). Edges are listed in the cells they may be near; a point meets those of its cell."""
    reach = math.degrees(metres / RADIUS)
    width = wrap_lon(F.col("x1") - F.col("x0"))
    bulge = F.degrees(F.pow(F.radians(width), F.lit(2.0)) * 0.75)  # a great circle's way off its end's latitudes
    near = reach + bulge
    south, north = F.least("y0", "y1") - near, F.greatest("y0", "y1") + near
    far = F.greatest(F.abs(south), F.abs(north))
    around = F.when(far >= 89.0, 180.0).otherwise(reach / F.cos(F.radians(F.least(far, F.lit(89.0)))) + 1e-6)
    n = round(360 / size)
    west = F.col("x0") + F.least(F.lit(0.0), width) - around
    columns = F.least(F.ceil((F.abs(width) + 2 * around) / size) + 1, F.lit(n))
    placed = edges.withColumns({"_west": F.floor((west + 180.0) / size), "_n": columns, "_cy": F.sequence(F.floor(south / size), F.floor(north / size))})
    placed = placed.withColumn("_cy", F.explode("_cy")).withColumn("_cx", F.explode(F.sequence(F.col("_west"), F.col("_west") + F.col("_n") - 1)))
    placed = placed.withColumn("_cx", F.pmod("_cx", F.lit(n).cast("long")))
    cells = points.select(key, "lon", "lat", F.floor(F.col("lat") / size).alias("_cy"), F.floor((wrap_lon("lon") + 180.0) / size).alias("_cx"))
    met = cells.join(placed.select("_cx", "_cy", "x0", "y0", "x1", "y1").distinct(), ["_cx", "_cy"])
    return met.where(segment_within("x0", "y0", "x1", "y1", "lon", "lat", metres)).select(key).distinct()


def limit_seconds(samples: DataFrame, keys: list[str], over: Column, seconds: str) -> DataFrame:
    """Seconds over a limit by leg, where there are any."""
    return samples.groupBy(*keys).agg(F.sum(F.when(over, F.col(seconds)).otherwise(0.0)).alias("over_s")).where("over_s > 0")


def stale_area(lon: Column, lat: Column, c_lon: Column, c_lat: Column, half_width_deg: float) -> Column:
    """Whether a vessel has moved over a third of the half-width from an area's centre."""
    return haversine(lon, lat, c_lon, c_lat) > half_width_deg / 3 * 111_195.0


def in_units(values: DataFrame, units: DataFrame) -> DataFrame:
    """values (quantity, v) in the units a reader has chosen (quantity, unit, factor, shift): a small dimension."""
    return values.join(units, "quantity", "left").withColumn("shown", F.col("v") * F.coalesce("factor", F.lit(1.0)) + F.coalesce("shift", F.lit(0.0)))


def checked_settings(settings: DataFrame, specs: DataFrame) -> DataFrame:
    """key, value and `problem` (null if none), against specs: key, kind, low, high, options."""
    met = settings.join(specs, "key", "left")
    n = F.expr("try_cast(value as double)")
    problem = F.when(F.col("kind").isNull(), "unknown setting").when((F.col("kind") == "number") & n.isNull(), "not a number")
    problem = problem.when((F.col("kind") == "number") & ((n < F.col("low")) | (n > F.col("high"))), "out of range").when((F.col("kind") == "enum") & ~F.coalesce(F.array_contains("options", F.col("value")), F.lit(False)), "not an option")
    return met.select("key", "value", problem.alias("problem"))
