"""Sampling of gridded fields in long form: (row, col, v). Positions are fractional cells x (columns) and y (rows)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.angles import at_least, at_most, clamp


@dataclass(frozen=True)
class Geometry:
    """Origin, spacing and shape of a grid; wrap for one that goes around the globe."""

    lat0: float
    lon0: float
    d_lat: float
    d_lon: float
    n_lat: int
    n_lon: int
    wrap: bool = False

    def xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Fractional column and row. Columns run east from the first, across the date line too; on a grid that does not go around,
        positions past its end, where west is shorter, lie west of its first column."""
        east = F.pmod(lon - self.lon0, F.lit(360.0))
        if not self.wrap:
            east = F.when(east > max(180.0, (self.n_lon - 1) * self.d_lon), east - 360.0).otherwise(east)
        return east / self.d_lon, (lat - self.lat0) / self.d_lat

    def rows_cols(self, box: tuple[float, float, float, float], margin: int = 1) -> Column:
        """Whether a cell may bear on a box: a filter of literal ranges, which reaches the scan."""
        w, s, e, n = box
        clip = lambda v, top: max(0, min(top - 1, int(v)))
        rows = sorted((clip((s - self.lat0) / self.d_lat - margin, self.n_lat), clip((n - self.lat0) / self.d_lat + 1 + margin, self.n_lat)))
        spans = [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
        at = lambda lon: (lon - self.lon0) % 360.0 / self.d_lon if self.wrap else ((lon - self.lon0 + 180.0) % 360.0 - 180.0 if (self.n_lon - 1) * self.d_lon <= 180.0 else (lon - self.lon0) % 360.0) / self.d_lon
        cols = F.lit(False)
        for a, b in spans:
            x0, x1 = at(a), at(b)
            if x0 <= x1:
                cols |= F.col("col").between(clip(x0 - margin, self.n_lon), clip(x1 + 1 + margin, self.n_lon))
            else:
                cols |= (F.col("col") >= clip(x0 - margin, self.n_lon)) | (F.col("col") <= clip(x1 + 1 + margin, self.n_lon))
        return F.col("row").between(*rows) & cols


def _cut(i: Column, top: int) -> Column:
    """A whole number cut to 0..top."""
    return at_least(at_most(i, top), 0)


def corners(x: Column, y: Column, g: Geometry) -> dict[str, Column]:
    """c0, c1, r0, r1 and the shares tx, ty: clamped at the edges, columns modulo where the grid wraps; null for a null position."""
    c = F.floor(x).cast("int")
    if g.wrap:
        c0, c1, tx = F.pmod(c, F.lit(g.n_lon)), F.pmod(c + 1, F.lit(g.n_lon)), x - F.floor(x)
    else:
        c0 = _cut(c, max(g.n_lon - 2, 0))
        c1, tx = at_most(c0 + 1, g.n_lon - 1), clamp(x - c0, 0, 1)
    r0 = _cut(F.floor(y).cast("int"), max(g.n_lat - 2, 0))
    return {"c0": c0, "c1": c1, "r0": r0, "r1": at_most(r0 + 1, g.n_lat - 1), "tx": tx, "ty": clamp(y - r0, 0, 1)}


def _quads(field: DataFrame, g: Geometry, value: str) -> DataFrame:
    """(row, col, v00, v01, v10, v11): each cell with its neighbours to the right and below, as far as they are present."""
    steps = [(dr, dc) for dr in ((0, 1) if g.n_lat > 1 else (0,)) for dc in ((0, 1) if g.n_lon > 1 else (0,))]
    left = lambda dc: F.pmod(F.col("col") - dc, F.lit(g.n_lon)) if g.wrap else F.col("col") - dc
    anchors = F.array(*(F.struct((F.col("row") - dr).alias("row"), left(dc).alias("col"), F.lit(2 * dr + dc).alias("_k")) for dr, dc in steps))
    seen = field.select(F.col(value).alias("_v"), F.inline(anchors)).where("row >= 0 and col >= 0")
    own = lambda dr, dc: F.max(F.when(F.col("_k") == 2 * (dr if g.n_lat > 1 else 0) + (dc if g.n_lon > 1 else 0), F.col("_v")))
    return seen.groupBy("row", "col").agg(*(own(dr, dc).alias(f"v{dr}{dc}") for dr in (0, 1) for dc in (0, 1)))


def _with_corners(points: DataFrame, field: DataFrame, g: Geometry, value: str) -> DataFrame:
    """points with v00, v01, v10, v11 (row, then column). The field's cells meet their neighbours once; a point is one row, joined once."""
    placed = points.withColumns({f"_{k}": v for k, v in corners(F.col("x"), F.col("y"), g).items() if k in ("c0", "r0", "tx", "ty")})
    quads = _quads(field, g, value).withColumnsRenamed({"row": "_r0", "col": "_c0"})
    return placed.join(quads, ["_r0", "_c0"], "left")


def bilinear(points: DataFrame, field: DataFrame, g: Geometry, value: str = "v", out: str = "sample") -> DataFrame:
    """points (with x, y) and `out`: along the columns, then the rows; null if a corner is."""
    m = _with_corners(points, field, g, value)
    low, high = F.col("v00") + F.col("_tx") * (F.col("v01") - F.col("v00")), F.col("v10") + F.col("_tx") * (F.col("v11") - F.col("v10"))
    return m.select(*points.columns, (low + F.col("_ty") * (high - low)).alias(out))


def bilinear_present(points: DataFrame, field: DataFrame, g: Geometry, value: str = "v", out: str = "sample") -> DataFrame:
    """Missing corners drop out and the others' weights are scaled up; null if none is left."""
    m = _with_corners(points, field, g, value)
    tx, ty = F.col("_tx"), F.col("_ty")
    weights = {"v00": (1 - tx) * (1 - ty), "v01": tx * (1 - ty), "v10": (1 - tx) * ty, "v11": tx * ty}
    has = lambda k, c: F.when(F.col(k).isNotNull(), c).otherwise(0.0)
    total = sum((has(k, w) for k, w in weights.items()), F.lit(0.0))
    mean = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)) / F.when(total > 1e-12, total)
    return m.select(*points.columns, mean.alias(out))


def nearest(points: DataFrame, field: DataFrame, g: Geometry, value: str = "v", out: str = "sample") -> DataFrame:
    """For categories: the cell at the rounded position; null for a null position."""
    c = F.floor(F.col("x") + 0.5).cast("int")
    c = F.pmod(c, F.lit(g.n_lon)) if g.wrap else _cut(c, g.n_lon - 1)
    r = _cut(F.floor(F.col("y") + 0.5).cast("int"), g.n_lat - 1)
    return points.withColumns({"row": r, "col": c}).join(field.select("row", "col", F.col(value).alias(out)), ["row", "col"], "left").select(*points.columns, out)


def _offsets(radius: int) -> list[tuple[int, int]]:
    return [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if 0 < dr * dr + dc * dc <= radius * radius]


def _neighbours(field: DataFrame, radius: int, value: str, around: int | None) -> DataFrame:
    """(row, col, dr, dc, v): every present cell, as seen from the cells within the radius of it."""
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in _offsets(radius) if around is None or -around < 2 * dc <= around))
    seen = field.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v"), F.inline(steps))
    col = F.col("col") - F.col("dc")
    return seen.select((F.col("row") - F.col("dr")).alias("row"), (col if around is None else F.pmod(col, F.lit(around))).alias("col"), "dr", "dc", "v")


def fill_idw(field: DataFrame, radius: int = 2, value: str = "v", around: int | None = None) -> DataFrame:
    """(row, col, v, filled): missing cells take the mean of present ones within the radius by inverse squared distance. around: the
    columns of a grid that goes around the globe, whose last is next to its first."""
    near = _neighbours(field, radius, value, around).withColumn("w", 1.0 / (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")))
    fills = near.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("_fill"))
    return field.select("row", "col", F.col(value).alias("v")).join(fills, ["row", "col"], "left").select("row", "col", F.coalesce("v", "_fill").alias("v"), (F.col("v").isNull() & F.col("_fill").isNotNull()).alias("filled"))


def fill_nearest(field: DataFrame, radius: int = 3, value: str = "v", around: int | None = None) -> DataFrame:
    """(row, col, v): missing cells take the nearest present one within the radius, faded to 0 with distance; 0 beyond. Ties: first by row,
    then column. around: as above."""
    d = F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"))
    near = _neighbours(field, radius, value, around).groupBy("row", "col").agg(F.min(F.struct((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"), "dr", "dc", (F.col("v") * (1 - d / radius)).alias("fade"))).alias("m"))
    return field.select("row", "col", F.col(value).alias("v")).join(near, ["row", "col"], "left").select("row", "col", F.coalesce("v", "m.fade", F.lit(0.0)).alias("v"))


def harmonic(constituents: DataFrame, times: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """keys, t and `u`: sum of amp * cos(speed * t + arg - phase), in degrees, over a key's constituents (a small dimension)."""
    angle = F.radians(F.col("speed") * F.col(t) + F.col("arg") - F.col("phase"))
    return times.join(constituents, keys).groupBy(*keys, t).agg(F.sum(F.col("amp") * F.cos(angle)).alias("u"))
