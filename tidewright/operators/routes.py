"""Routes, runs and requests as tables: totals, metrics, plans, legs, validation, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.angles import rounded
from tidewright.functions.geodesy import bearing, haversine


def with_legs(points: DataFrame, keys: list[str], order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with `leg_m` and `course` from the point before (0 and null at the first), and `along_m`."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = points.withColumns({"_x": F.lag(lon).over(w), "_y": F.lag(lat).over(w)})
    p = p.withColumns({"leg_m": F.coalesce(haversine("_x", "_y", lon, lat), F.lit(0.0)), "course": F.when(F.col("_x").isNotNull(), bearing("_x", "_y", lon, lat))})
    return p.withColumn("along_m", F.sum("leg_m").over(w)).drop("_x", "_y")


def departure_metrics(points: DataFrame, keys: list[str], order: list[str], wind: str, wave: str, index: str, twa: str, leg_s: str, sailing: Column) -> DataFrame:
    """Per route: worst wind, wave and sea, and the seconds sailed upwind; a leg's time stands at the point it leaves from."""
    w = Window.partitionBy(*keys).orderBy(*order)
    p = points.withColumn("_s", F.lag(leg_s).over(w))
    upwind = F.sum(F.when((F.col(twa) < 60) & sailing, F.coalesce("_s", F.lit(0))).otherwise(0))
    return p.groupBy(*keys).agg(F.max(wind).alias("max_wind"), F.max(wave).alias("max_wave"), F.max(index).alias("max_index"), upwind.alias("upwind_s"))


def spread(df: DataFrame, keys: list[str], value: str, done: Column) -> DataFrame:
    """Earliest, latest and lower median of the members that are done, and how many are and are not."""
    v = F.col("_v")
    return df.withColumn("_v", F.when(done, F.col(value))).groupBy(*keys).agg(F.min(v).alias("earliest"), F.max(v).alias("latest"), F.expr("percentile_disc(0.5) within group (order by _v)").alias("median"), F.count(v).alias("done"), F.count_if(~done).alias("left"))


def beam(candidates: DataFrame, keys: list[str], cost: str, tie: str, leader: str) -> DataFrame:
    """The cheapest candidate of each bin, and the leader (least `leader`) of each first key; a row once."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(cost, tie))
    ahead = F.row_number().over(Window.partitionBy(keys[0]).orderBy(leader, tie))
    return candidates.withColumns({"_b": best, "_l": ahead}).where("_b = 1 or _l = 1").drop("_b", "_l")


def plan_legs(stops: DataFrame, keys: list[str], order: str, stop: str) -> DataFrame:
    """Pairs of consecutive stops with their number and whether they are the last."""
    w = Window.partitionBy(*keys).orderBy(order)
    legs = stops.withColumns({"to": F.lead(stop).over(w), "leg": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys))})
    return legs.where("leg < _n").select(*keys, "leg", F.col(stop).alias("from"), "to", (F.col("leg") == F.col("_n") - 1).alias("is_last"))


def best_plan(samples: DataFrame, keys: list[str], order: str, plans: dict[str, Column]) -> DataFrame:
    """keys, segment, plan, first, last: the fastest sail plan at each sample (the first named wins a tie), cut where it changes."""
    from tidewright.operators.series import collapse_runs

    pick = F.lit(None).cast("string")
    top = F.greatest(*plans.values())
    for name, speed in reversed(list(plans.items())):
        pick = F.when(speed == top, name).otherwise(pick)
    return collapse_runs(samples.withColumn("plan", pick), keys, [order], "plan").withColumnRenamed("run", "segment")


def validated(rows: DataFrame, rules: dict[str, tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with `problems`: field, then message."""
    problems = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{field}: {message}")) for field, (ok, message) in rules.items())))
    checked = rows.withColumn("problems", problems)
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


def geojson(points: DataFrame, route: str, order: str, properties: list[str]) -> DataFrame:
    """A GeoJSON document a route: its line, then its points with their properties."""
    coordinate = F.array("lon", "lat")
    seq = lambda x: F.transform(F.array_sort(F.collect_list(F.struct(order, x.alias("v")))), lambda y: y["v"])
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), coordinate.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    both = points.groupBy(route).agg(seq(coordinate).alias("line"), seq(point).alias("points"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")).alias("geometry")))
    return both.select(route, F.concat(F.lit('{"type":"FeatureCollection","features":['), line, F.lit(","), F.expr("substring(to_json(points), 2)"), F.lit("}")).alias("geojson"))


def polar_csv(table: DataFrame, polar: str, winds: list[float]) -> DataFrame:
    """Lines of a polar in knots: polar, twa, line."""
    knots = lambda c: F.format_string("%.2f", rounded(c * 3600 / 1852, 2))
    wide = table.groupBy(polar, "twa").pivot("tws", winds).agg(F.first("speed"))
    cells = [F.when(F.col(f"`{w}`").isNull(), "").otherwise(knots(F.col(f"`{w}`"))) for w in winds]
    return wide.select(polar, "twa", F.concat_ws(",", F.format_string("%.1f", "twa"), *cells).alias("line"))


def step_ladder(cycles: DataFrame, horizon_h: int) -> DataFrame:
    """cycle (a timestamp) and its published steps: 3-hourly to 144, then 6-hourly to 240 for the cycles at 0 and 12."""
    near = F.sequence(F.lit(0), F.lit(min(144, horizon_h)), F.lit(3))
    far = F.sequence(F.lit(150), F.lit(max(150, min(240, horizon_h))), F.lit(6)) if horizon_h >= 150 else F.array().cast("array<int>")
    long_ = F.hour("cycle") % 12 == 0
    return cycles.withColumn("step_h", F.explode(F.when(long_, F.concat(near, far)).otherwise(near)))


def latest_cycle(now_s: Column, lag_long_s: int = 454 * 60, lag_short_s: int = 387 * 60) -> Column:
    """Seconds of the newest 6-hourly cycle that is out: its time and its lag are past."""
    at = lambda lag: F.floor((now_s - lag) / 21600) * 21600
    long_ = F.floor((now_s - lag_long_s) / 43200) * 43200
    short = at(lag_short_s)
    short = F.when(short % 43200 == 0, short - 21600).otherwise(short)
    return F.greatest(long_, short)


def generation(*parts: str | Column) -> Column:
    """A hash of all that a cached thing depends on."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)), 256)


def blocked(flags: Column, clearance: Column, depth: Column, hazard: Column, air_draft: float, draught: float, overhead: float = 2.0, under: float = 0.5) -> Column:
    """Whether a chart triangle may not be entered. flags: 1 opening bridge, 2 navigable, 4 mark, 8 channel mark, 16 fairway, 32 structure."""
    bit = lambda n: flags.bitwiseAND(n) > 0
    low = F.coalesce(clearance < air_draft + overhead, F.lit(False))
    shallow = ~bit(2) & F.coalesce(depth < draught + under, F.lit(False))
    return bit(1) | low | shallow | F.coalesce(hazard < draught + under, F.lit(False)) | (bit(4) & ~bit(8) & ~bit(16)) | bit(32)


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> tuple[Column, ...]:
    """Red, green and blue of a piecewise-linear ramp, held at its ends."""
    out = []
    for k in range(3):
        c = F.lit(float(stops[-1][1][k]))
        for (x0, a), (x1, b) in reversed(list(zip(stops, stops[1:], strict=False))):
            c = F.when(value < x1, a[k] + (value - x0) / (x1 - x0) * (b[k] - a[k])).otherwise(c)
        out.append(F.floor(F.when(value < stops[0][0], float(stops[0][1][k])).otherwise(c) + 0.5).cast("int"))
    return tuple(out)
