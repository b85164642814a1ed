"""Meteorology and sea state, as Column expressions. SI units; wind and waves FROM, currents TO."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.angles import angle_between, at_least, at_most, atan2, clamp, col, finite, fold180, norm360, rounded

# Bounds of the scales.
BEAUFORT = [0.3, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7]
DOUGLAS = [0.0001, 0.1, 0.5, 1.25, 2.5, 4.0, 6.0, 9.0, 14.0]
BANDS = [(35, "smooth"), (50, "good"), (75, "slight"), (100, "choppy"), (150, "rough")]
PRECIPITATION = {0: "none", 1: "rain", 3: "freezing rain", 5: "snow", 6: "wet snow", 7: "rain and snow", 8: "ice pellets", 12: "freezing drizzle"}
G = 9.80665


def ladder(x, bounds: list[float]) -> Column:
    """How many bounds are at most x; null for null."""
    return reduce(lambda a, b: a + b, ((col(x) >= bound).cast("int") for bound in bounds))


def beaufort(wind_ms) -> Column:
    return ladder(wind_ms, BEAUFORT)


def douglas(swh_m) -> Column:
    return ladder(swh_m, DOUGLAS)


def band(index) -> Column:
    out = F.when(col(index).isNull(), None).when(col(index) < BANDS[0][0], BANDS[0][1])
    for cut, name in BANDS[1:]:
        out = out.when(col(index) < cut, name)
    return out.otherwise("extreme")


def _wind_part(w: Column, c: Column, wind_from, current_to, cos=F.cos) -> Column:
    """For values that are known: the guards stand around it, once."""
    theta = F.radians(angle_between(col(wind_from) + 180.0, current_to))
    relative = (w * w + c * c - 2 * w * c * cos(theta)) / F.pow(F.greatest(w, F.lit(0.001)), 2)
    return F.least(50.0 * relative * F.greatest(F.lit(0.0), F.least(F.lit(1.0), w / 2.572222)), F.lit(400.0))


def _wave_part(c: Column, current_to, h: Column, t: Column, mwd_from, cos=F.cos) -> Column:
    phi = F.radians(angle_between(col(mwd_from) + 180.0, current_to))
    group = G * F.greatest(t, F.lit(2.0)) / (4 * math.pi)
    steepen = 1.0 / F.greatest(1 - 2 * F.greatest(-(c * cos(phi)), F.lit(0.0)) / group, F.lit(0.3))
    return F.when(h > 0, 10.0 * h * h * (5.0 / F.greatest(t, F.lit(5.0))) * steepen).otherwise(0.0)


def _all_known(*values) -> Column:
    return reduce(lambda a, b: a & b, (col(v).isNotNull() for v in values))


def roughness(wind, current, wind_from, current_to, swh, mwp, mwd_from) -> Column:
    """Wind against current, and swell by its square, damped by period and steepened by an opposing current. Null if any is."""
    parts = _wind_part(col(wind), col(current), wind_from, current_to) + _wave_part(col(current), current_to, col(swh), col(mwp), mwd_from)
    return F.when(_all_known(wind, current, wind_from, current_to, swh, mwp, mwd_from), parts)


def sea_state_index(wind, wind_from, current, current_to, swh, mwp, mwd_from, cos=F.cos) -> Column:
    """Rounded to a tenth; null without wind or its direction. Without current it counts as none; unless height, period and direction
    of the waves are all known, so do they. What is not finite is not known. cos: libm's, where sums can lie on the edge of a tenth."""
    w, w_from, h, t, d = map(finite, (wind, wind_from, swh, mwp, mwd_from))
    c, to = (F.coalesce(finite(x), F.lit(0.0)) for x in (current, current_to))
    waves = F.when(_all_known(h, t, d), _wave_part(c, to, h, t, d, cos)).otherwise(0.0)
    return rounded(F.when(_all_known(w, w_from), _wind_part(w, c, w_from, to, cos) + waves), 1)


def encounter(index, course, waves_from) -> Column:
    return col(index) * (1.05 + 0.25 * F.cos(F.radians(angle_between(course, waves_from))))


def sector(course, waves_from) -> Column:
    a = angle_between(course, waves_from)
    return F.when(a.isNull(), None).when(a < 30, "head").when(a < 60, "bow").when(a <= 120, "beam").when(a <= 150, "quarter").otherwise("following")


def comfort_rate(index, weight) -> Column:
    return F.when(col(index) > 75, col(weight) * F.least(F.lit(2.0), (col(index) - 75) / 100)).when(col(index).isNotNull(), 0.0)


def relative_humidity(t_k, dew_k) -> Column:
    magnus = lambda k: F.exp(17.625 * (col(k) - 273.15) / (243.04 + (col(k) - 273.15)))
    return clamp(magnus(dew_k) / magnus(t_k), 0, 1)


def wind_chill(t_c, wind_ms) -> Column:
    """Null outside its range of 10 °C and less in 1.34 m/s and more."""
    v = F.pow(col(wind_ms) * 3.6, F.lit(0.16))
    return F.when((col(t_c) <= 10) & (col(wind_ms) >= 1.34), 13.12 + 0.6215 * col(t_c) - 11.37 * v + 0.3965 * col(t_c) * v)


def heat_index(t_c, rh) -> Column:
    """Rothfusz's regression with its two adjustments; null under 27 °C or 40 % humidity."""
    f, r = col(t_c) * 9 / 5 + 32, col(rh) * 100
    base = -42.379 + 2.04901523 * f + 10.14333127 * r - 0.22475541 * f * r - 0.00683783 * f * f - 0.05481717 * r * r + 0.00122874 * f * f * r + 0.00085282 * f * r * r - 0.00000199 * f * f * r * r
    dry = F.when((r < 13) & (f >= 80) & (f <= 112), (13 - r) / 4 * F.sqrt(F.greatest(F.lit(0.0), (17 - F.abs(f - 95)) / 17))).otherwise(0.0)
    wet = F.when((r > 85) & (f >= 80) & (f <= 87), (r - 85) / 10 * ((87 - f) / 5)).otherwise(0.0)
    return F.when((col(t_c) >= 27) & (col(rh) >= 0.4), (base - dry + wet - 32) * 5 / 9)


def feels_like(t_c, wind_ms, rh) -> tuple[Column, Column]:
    """Value and basis: chill, then heat, then air; both null without a temperature."""
    chill, heat = wind_chill(t_c, wind_ms), heat_index(t_c, rh)
    return F.coalesce(chill, heat, col(t_c)), F.when(chill.isNotNull(), "wind_chill").when(heat.isNotNull(), "heat_index").when(col(t_c).isNotNull(), "air")


def precipitation(code) -> Column:
    """Of a code, rounded half up; null for null and what is not finite."""
    whole = rounded(col(code).cast("double"))
    out = F.when(whole.isNull(), None)
    for k, v in PRECIPITATION.items():
        out = out.when(whole == k, v)
    return out.otherwise("other")


def wind_from(u, v, atan2=atan2) -> Column:
    return norm360(270.0 - F.degrees(atan2(col(v), col(u))))


def current_to(u, v, atan2=atan2) -> Column:
    return norm360(F.degrees(atan2(col(u), col(v))))


def relation(along_ms) -> Column:
    """Of waves to a current's component along them; without a current, none."""
    return F.when(col(along_ms) <= -0.1, "opposing").when(col(along_ms) >= 0.1, "following").otherwise("none")


def apparent_wind(tws, twa_deg, speed) -> tuple[Column, Column]:
    x, y = col(tws) * F.cos(F.radians(col(twa_deg))) + col(speed), col(tws) * F.sin(F.radians(col(twa_deg)))
    return F.sqrt(x * x + y * y), fold180(F.degrees(F.atan2(y, x)))


def mjd(ts) -> Column:
    """Modified Julian date of a timestamp in UTC."""
    return F.unix_micros(col(ts).cast("timestamp")) / 86_400_000_000.0 + 40_587.0


def surge(tide, total, offset) -> Column:
    return col(total) - col(tide) - col(offset)
