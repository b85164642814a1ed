"""Boat-speed tables in long form: (polar, twa, tws, speed, available)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.angles import at_least, fold180


def _axes(table: DataFrame, keys: list[str]) -> DataFrame:
    """A row a polar: keys, its angles and wind speeds in order, and the speeds by angle, then wind speed (null where unavailable)."""
    axes = table.groupBy(*keys).agg(*(F.array_sort(F.collect_set(a)).alias(f"_{a}s") for a in ("twa", "tws")))
    cells = axes.select(*keys, F.explode("_twas").alias("twa"), "_twss").select(*keys, "twa", F.explode("_twss").alias("tws"))
    speeds = table.groupBy(*keys, "twa", "tws").agg(F.max(F.when(F.col("available"), F.col("speed"))).alias("_s"))
    rows = cells.join(speeds, [*keys, "twa", "tws"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("twa", "tws", "_s"))).alias("_all"))
    return axes.join(rows.select(*keys, F.col("_all._s").alias("_speeds")), keys)


def boat_speed(points: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, twa, tws) with `speed`: bilinear, linearly extrapolated beyond the table, mirrored in twa, never negative; null where
    a corner that counts is unavailable, the angle or wind is null, or the polar is unknown. A polar with one angle or wind speed
    has the same speed at all. Each polar is one row of some hundred numbers, in which its points look up their cell: one join."""
    p = points.withColumn("_a", fold180("twa")).join(_axes(table, keys), keys, "left")

    def cell(x: str, axis: str) -> tuple[Column, Column]:
        at, n = F.size(F.filter(axis, lambda v: v <= F.col(x))), F.size(axis)
        low = F.greatest(F.lit(0), F.least(at - 1, n - 2))
        a, b = F.get(axis, low), F.get(axis, F.least(low + 1, n - 1))
        return low, F.when(b > a, (F.col(x) - a) / (b - a)).when(F.col(x).isNotNull(), 0.0)

    (i, ta), (j, ts) = cell("_a", "_twas"), cell("tws", "_twss")
    p = p.withColumns({"_i": i, "_j": j, "_ta": ta, "_ts": ts})
    wide = F.size("_twss")
    down, along = (F.least(F.col(k) + 1, F.size(axis) - 1) for k, axis in (("_i", "_twas"), ("_j", "_twss")))
    s = {(a, b): F.get("_speeds", r * wide + c) for a, r in enumerate((F.col("_i"), down)) for b, c in enumerate((F.col("_j"), along))}
    line = lambda a, b, t: F.when(t == 0, a).when(t == 1, b).otherwise(a + t * (b - a))
    speed = line(line(s[0, 0], s[0, 1], F.col("_ts")), line(s[1, 0], s[1, 1], F.col("_ts")), F.col("_ta"))
    return p.select(*points.columns, at_least(speed, 0.0).alias("speed"))


def best_angles(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tws, beat and run: the angle of the best speed to windward (20..89) and to leeward (90..179), by whole degrees; the
    first wins a tie; 45 and 150 where none makes way."""
    grid = table.select(*keys, "tws").distinct().withColumn("twa", F.explode(F.sequence(F.lit(20), F.lit(179)))).withColumn("twa", F.col("twa").cast("double"))
    made = boat_speed(grid, table, keys).withColumn("vmg", F.col("speed") * F.abs(F.cos(F.radians("twa"))))
    pick = lambda up: F.max(F.when(((F.col("twa") < 90) if up else (F.col("twa") >= 90)) & (F.col("vmg") > 0), F.struct(F.col("vmg"), (-F.col("twa")).alias("a"))))
    return made.groupBy(*keys, "tws").agg(F.coalesce(-pick(True)["a"], F.lit(45.0)).alias("beat"), F.coalesce(-pick(False)["a"], F.lit(150.0)).alias("run"))


def wave_factor(points: DataFrame, layers: DataFrame) -> DataFrame:
    """points (height, period, angle) with `factor`: linear in angle, period, then height; null outside the table (height, period, angle, factor)."""
    axes = ["angle", "period", "height"]
    p, corner_of = points.withColumn("_key", F.monotonically_increasing_id()), []
    for a in axes:
        steps = F.broadcast(layers.select(F.col(a).alias(f"{a}0")).distinct().withColumn(f"{a}1", F.lead(f"{a}0").over(Window.orderBy(f"{a}0"))).where(f"{a}1 is not null"))  # an axis of a table
        top = layers.agg(F.max(a)).first()[0]
        p = p.join(steps, (F.col(a) >= F.col(f"{a}0")) & ((F.col(a) < F.col(f"{a}1")) | ((F.col(a) == top) & (F.col(f"{a}1") == top))), "left")
    for n in range(8):
        ends = [n >> i & 1 for i in range(3)]
        corner = layers.select(*(F.col(a).alias(f"{a}{e}") for a, e in zip(axes, ends, strict=True)), F.col("factor").alias(f"f{n}"))
        p = p.join(corner, [f"{a}{e}" for a, e in zip(axes, ends, strict=True)], "left")
    values = [F.col(f"f{n}") for n in range(8)]
    for a in axes:
        t = (F.col(a) - F.col(f"{a}0")) / (F.col(f"{a}1") - F.col(f"{a}0"))
        values = [v + t * (u - v) for v, u in zip(values[::2], values[1::2], strict=True)]
    return p.select(*points.columns, values[0].alias("factor"))
