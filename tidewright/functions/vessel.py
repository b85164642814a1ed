"""Sailing decisions and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.angles import col, lon_offset


def tack_between(course_a, course_b, wind_from) -> Column:
    """Whether the wind changes sides between two courses."""
    a, b = lon_offset(wind_from, course_a), lon_offset(wind_from, course_b)
    return (a * b < 0) & (F.abs(a) < 180) & (F.abs(b) < 180)


def tack_charge(sailing_before, sailing_after, turned, seconds: float = 30.0) -> Column:
    return F.when(col(sailing_before) & col(sailing_after) & col(turned), seconds).otherwise(0.0)


def select_speed(sail, motor, policy: str, threshold: float = 0.0) -> tuple[Column, Column]:
    """Speed, and whether it is sailed. Policies: motor, fastest, sail_max (sail from the threshold on)."""
    sails = {"motor": F.lit(False), "fastest": col(sail) > col(motor), "sail_max": col(sail) >= threshold}[policy]
    return F.when(sails, col(sail)).otherwise(col(motor)), sails


def coast_factor(distance, radius: float, most: float = 1.4) -> Column:
    """`most` on the shore, falling to 1 at the radius."""
    return F.when(col(distance) >= radius, 1.0).otherwise(most - (most - 1) * col(distance) / radius)


def slug(name) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def position_text(lat, lon) -> Column:
    part = lambda x, pos, neg, width: F.concat(F.lpad(F.floor(F.abs(col(x))).cast("int").cast("string"), width, "0"), F.lit("°"), F.lpad(F.floor((F.abs(col(x)) - F.floor(F.abs(col(x)))) * 60).cast("int").cast("string"), 2, "0"), F.lit("'"), F.when(col(x) < 0, neg).otherwise(pos))
    return F.concat(part(lat, "N", "S", 2), F.lit(" "), part(lon, "E", "W", 3))


def freshness(now, due) -> Column:
    """green until 30 minutes before it is due, orange until 60 after, then red. Both in seconds."""
    late = col(now) - col(due)
    return F.when(late < -1800, "green").when(late < 3600, "orange").otherwise("red")
