"""Angles in degrees, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def rounded(x: Column | str, digits: int = 0) -> Column:
    """Half up, null for what is not finite: the same bits in any engine that has floor."""
    x, scale = col(x), float(10**digits)
    y = F.floor(x * scale + 0.5) / scale
    return F.when(F.abs(x) < float("inf"), y)  # NaN is above infinity


def atan2(y: Column | str, x: Column | str) -> Column:
    """With IEEE's signs of zero: half a turn where both are zero and x is -0.0, which Spark's own takes for 0.0. The half turn is pi whatever
    the sign of y: -pi is the same angle."""
    y, x = col(y), col(x)
    return F.when((y == 0) & (x == 0) & (F.pow(x, F.lit(-1.0)) < 0), math.pi).otherwise(F.atan2(y, x))


def norm360(x: Column | str) -> Column:
    """In [0, 360), by the steps that SQL takes: adding 360 rounds off last bits, and pmod() would keep them for positive angles."""
    turn = F.lit(360.0)
    return (col(x) % turn + turn) % turn


def wrap_lon(x: Column | str) -> Column:
    """In [-180, 180)."""
    return F.pmod(col(x) + 180.0, F.lit(360.0)) - 180.0


def lon_offset(x: Column | str, ref: Column | str) -> Column:
    """Degrees east of ref, in [-180, 180)."""
    return wrap_lon(col(x) - col(ref))


def unwrap_near(x: Column | str, ref: Column | str) -> Column:
    """x plus the multiple of 360 that brings it within 180 of ref."""
    return col(x) - 360.0 * F.floor((col(x) - col(ref)) / 360.0 + 0.5)


def fold180(x: Column | str) -> Column:
    """The smaller angle, in [0, 180]."""
    y = norm360(x)
    return F.least(y, 360.0 - y)


def angle_between(a: Column | str, b: Column | str) -> Column:
    return fold180(col(a) - col(b))


def twa(heading: Column | str, wind_from: Column | str) -> Column:
    """True wind angle, in [0, 180]."""
    return angle_between(wind_from, heading)


def finite(x: Column | str | float) -> Column:
    """x, or null for what is not a finite number."""
    y = col(x).cast("double")
    return F.when(F.abs(y) < float("inf"), y)


def at_least(x: Column | str | float, low) -> Column:
    """The larger of both; null for null, which greatest() would pass over."""
    return F.when(col(x).isNotNull(), F.greatest(col(x), F.lit(low)))


def at_most(x: Column | str | float, high) -> Column:
    """The smaller of both; null for null."""
    return F.when(col(x).isNotNull(), F.least(col(x), F.lit(high)))


def clamp(x: Column | str | float, low: float, high: float) -> Column:
    """x cut to the range; null for null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(x))))
