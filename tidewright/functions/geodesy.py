"""Great circles on a sphere and Web Mercator, as Column expressions. Metres and degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.angles import at_least, at_most, clamp, col, norm360, wrap_lon

RADIUS = 6_371_000.0
#: Web Mercator's latitude limit.
MERCATOR = 85.05112878


def haversine(lon1, lat1, lon2, lat2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(at_most(a, 1.0)))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    p1, p2, dl = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    return norm360(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def destination(lon, lat, bearing_deg, metres) -> tuple[Column, Column]:
    p, l, b, d = F.radians(col(lat)), F.radians(col(lon)), F.radians(col(bearing_deg)), col(metres) / RADIUS
    lat2 = F.asin(clamp(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b), -1, 1))
    lon2 = l + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return wrap_lon(F.degrees(lon2)), F.degrees(lat2)


def cross_track(s_lon, s_lat, e_lon, e_lat, lon, lat) -> Column:
    """Metres right of the great circle from s to e."""
    d = haversine(s_lon, s_lat, lon, lat) / RADIUS
    turn = F.radians(bearing(s_lon, s_lat, lon, lat) - bearing(s_lon, s_lat, e_lon, e_lat))
    return F.asin(clamp(F.sin(d) * F.sin(turn), -1, 1)) * RADIUS


def along_track(s_lon, s_lat, e_lon, e_lat, lon, lat) -> Column:
    d = haversine(s_lon, s_lat, lon, lat) / RADIUS
    turn = F.radians(bearing(s_lon, s_lat, lon, lat) - bearing(s_lon, s_lat, e_lon, e_lat))
    return F.atan2(F.cos(turn) * F.sin(d), F.cos(d)) * RADIUS


def segment_within(s_lon, s_lat, e_lon, e_lat, lon, lat, metres) -> Column:
    """Whether the leg from s to e passes within metres of a point; null if an end is unknown."""
    first, last = haversine(s_lon, s_lat, lon, lat), haversine(e_lon, e_lat, lon, lat)
    ends = F.when(first.isNotNull() & last.isNotNull(), F.least(first, last) <= col(metres))
    along = along_track(s_lon, s_lat, e_lon, e_lat, lon, lat)
    beside = (F.abs(cross_track(s_lon, s_lat, e_lon, e_lat, lon, lat)) <= col(metres)) & (along >= 0) & (along <= haversine(s_lon, s_lat, e_lon, e_lat))
    return F.when(ends.isNotNull(), ends | beside)


def slerp(lon1, lat1, lon2, lat2, share) -> tuple[Column, Column]:
    """The point at a share of the great circle between two points."""
    d = haversine(lon1, lat1, lon2, lat2) / RADIUS
    f = col(share)
    still = d < 1e-12
    a, b = F.when(still, 1 - f).otherwise(F.sin((1 - f) * d) / F.sin(d)), F.when(still, f).otherwise(F.sin(f * d) / F.sin(d))
    p1, p2, l1, l2 = (F.radians(col(x)) for x in (lat1, lat2, lon1, lon2))
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def mercator_y(lat) -> Column:
    return F.log(F.tan(math.pi / 4 + F.radians(clamp(lat, -MERCATOR, MERCATOR)) / 2))


def inverse_mercator_y(y) -> Column:
    return F.degrees(2 * F.atan(F.exp(col(y))) - math.pi / 2)


def tile_x(lon, zoom) -> Column:
    n = F.pow(F.lit(2.0), col(zoom))
    return at_most(at_least(F.floor((col(lon) + 180.0) / 360.0 * n), 0.0), n - 1).cast("int")


def tile_y(lat, zoom) -> Column:
    n = F.pow(F.lit(2.0), col(zoom))
    return at_most(at_least(F.floor((1 - mercator_y(lat) / math.pi) / 2 * n), 0.0), n - 1).cast("int")


def bbox_contains(box: tuple[float, float, float, float], lon, lat) -> Column:
    """box: west, south, east, north; west above east crosses the antimeridian."""
    w, s, e, n = box
    across = (col(lon) >= w) & (col(lon) <= e) if w <= e else (col(lon) >= w) | (col(lon) <= e)
    return across & (col(lat) >= s) & (col(lat) <= n)


def bbox_meets(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> bool:
    spans = lambda w, e: [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
    return a[1] <= b[3] and b[1] <= a[3] and any(x[0] <= y[1] and y[0] <= x[1] for x in spans(a[0], a[2]) for y in spans(b[0], b[2]))


def bbox_union(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The smaller of the two boxes around both."""
    south, north = min(a[1], b[1]), max(a[3], b[3])
    width = lambda w, e: (e - w) % 360.0
    around = [(a[0], b[2]), (b[0], a[2]), (a[0], a[2]), (b[0], b[2])]
    holds = lambda w, e: all((x - w) % 360.0 <= width(w, e) for x in (a[0], a[2], b[0], b[2]))
    w, e = min((x for x in around if holds(*x)), key=lambda x: width(*x), default=(-180.0, 180.0))
    return w, south, e, north
