"""Queries over composite fields, tides and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.angles import rounded
from tidewright.operators import fields as D
from tidewright.plans.base import OBS, collection, observations, r, table
from tidewright.plans.scalars import FOLD, LADDER, M, MAGNUS, NORM

QUERIES, ORACLES, query = collection()


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    o = observations(spark, sf_dir)
    return o.select(
        "event_id", "lon", "lat", "swh", "mwp", "mwd",
        ((e % 41) - 20.5).alias("u"), ((e % 37) - 18.25).alias("v"), ((e % 9) / F.lit(4.0) - 1.125).alias("cu"), ((e % 7) / F.lit(4.0) - 0.8).alias("cv"),
        (F.lit(263.15) + e % 50).alias("t_k"), (F.lit(260.15) + e % 50).alias("dew_k"), (98000.0 + e % 6000).alias("msl_pa"), (e % 6 == 0).alias("land"),
    )


FIELDS = f"""{OBS}, f AS (SELECT event_id, lon, lat, swh, mwp, mwd, (event_id % 41) - 20.5::DOUBLE AS u, (event_id % 37) - 18.25::DOUBLE AS v, (event_id % 9) / 4.0::DOUBLE - 1.125 AS cu, (event_id % 7) / 4.0::DOUBLE - 0.8 AS cv,
  263.15::DOUBLE + event_id % 50 AS t_k, 260.15::DOUBLE + event_id % 50 AS dew_k, 98000.0::DOUBLE + event_id % 6000 AS msl_pa, event_id % 6 = 0 AS land FROM obs),
  w AS (SELECT *, sqrt(u * u + v * v) AS wind, {NORM('270 - degrees(atan2(v, u))')} AS wf, sqrt(cu * cu + cv * cv) AS cur, {NORM('degrees(atan2(cu, cv))')} AS ct FROM f),
  x AS (SELECT *, least(400.0, 50.0 * ((wind * wind + cur * cur - 2 * wind * cur * cos(radians({FOLD('wf + 180 - ct')}))) / pow(greatest(wind, 0.001), 2)) * greatest(0, least(1, wind / 2.572222)))
    + CASE WHEN swh > 0 THEN 10.0 * swh * swh * (5.0 / greatest(mwp, 5.0)) * (1.0 / greatest(0.3, 1 - 2 * greatest(-(cur * cos(radians({FOLD('mwd + 180 - ct')}))), 0) / (9.80665 * greatest(mwp, 2.0) / (4 * pi())))) ELSE 0 END AS rough, cur * cos(radians({FOLD('mwd + 180 - ct')})) AS along FROM w),
  idx AS (SELECT *, {r('rough', 1)} AS idx FROM x)"""
BAND = "CASE WHEN idx < 35 THEN 'smooth' WHEN idx < 50 THEN 'good' WHEN idx < 75 THEN 'slight' WHEN idx < 100 THEN 'choppy' WHEN idx < 150 THEN 'rough' ELSE 'extreme' END"


@query(f"""WITH {FIELDS} SELECT event_id, {r('wind', 2)} AS wind_ms, {r('wf', 0)} AS wind_from, {r('cur', 3)} AS current_ms, {r('ct', 0)} AS current_to, {r(f"greatest(0, least(1, {MAGNUS('dew_k')} / {MAGNUS('t_k')}))", 3)} AS rh,
  ({LADDER('wind', M.BEAUFORT)}) AS beaufort, ({LADDER('greatest(swh, 0)', M.DOUGLAS)}) AS douglas, idx AS sea_index, {BAND} AS band, {r('msl_pa / 100', 1)} AS hpa FROM idx""")
def conditions_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.conditions(_fields(spark, sf_dir)).select("event_id", "wind_ms", "wind_from", "current_ms", "current_to", "rh", "beaufort", "douglas", "sea_index", "band", "hpa")


@query(f"WITH {FIELDS} SELECT lon, lat, {r('wind', 2)} AS speed, {r('wf', 1)} AS \"from\" FROM w")
def wind_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.wind_points(_fields(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT lon, lat, {r('cur', 3)} AS speed, {r('ct', 1)} AS \"to\" FROM w WHERE cur >= 0.3 AND NOT land")
def current_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.current_points(_fields(spark, sf_dir), 0.3)


@query(f"WITH {FIELDS} SELECT lon, lat, idx AS \"index\", {BAND} AS band, CASE WHEN along <= -0.1 THEN 'opposing' WHEN along >= 0.1 THEN 'following' ELSE 'none' END AS relation FROM idx WHERE NOT land")
def sea_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sea_points(_fields(spark, sf_dir))


@query(f"""WITH h AS (SELECT user_id, event_id, CASE WHEN event_id % 8 > 0 THEN value / 100 END AS tide, CASE WHEN event_id % 9 > 0 THEN value / 90 + 1 END AS total FROM events), s AS (SELECT user_id, avg(total - tide) AS shift, count(total - tide) AS samples FROM h WHERE total - tide IS NOT NULL GROUP BY 1)
  SELECT user_id, event_id, {r('tide', 6)} AS tide, {r('total - tide - shift', 6)} AS surge, {r('tide + (total - tide - shift)', 6)} AS level, samples FROM h LEFT JOIN s USING (user_id)""")
def tide_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    h = e.select("user_id", "event_id", F.when(F.col("event_id") % 8 > 0, F.col("value") / 100).alias("tide"), F.when(F.col("event_id") % 9 > 0, F.col("value") / 90 + 1).alias("total"))
    return D.tide_series(h, ["user_id"], "event_id").select("user_id", "event_id", rounded("tide", 6).alias("tide"), rounded("surge", 6).alias("surge"), rounded("level", 6).alias("level"), "samples")


ARGS = {k: f"({a!r}::DOUBLE + {b!r}::DOUBLE * (mjd - 15019.5))" for k, (a, b) in D.LONGITUDES.items()}
TAU = f"(360.0::DOUBLE * (mjd % 1) - {ARGS['s']} + {ARGS['h']})"
CASES = " ".join(f"WHEN '{n}' THEN {d[0]} * {TAU} + ({d[1]} * {ARGS['s']} + {d[2]} * {ARGS['h']} + {d[3]} * {ARGS['p']}) + {d[6]}" for n, d in D.DOODSON.items())


NODE = f"radians(-{ARGS['n']})"
FS = " ".join(f"WHEN '{n}' THEN {a!r} + {b!r} * cos({NODE})" for n, (a, b, _) in D.NODAL.items()) + f" WHEN 'M4' THEN pow(1.0 - 0.037 * cos({NODE}), 2)"
US = " ".join(f"WHEN '{n}' THEN {c!r} * sin({NODE})" for n, (_, _, c) in D.NODAL.items()) + f" WHEN 'M4' THEN -4.2 * sin({NODE})"


@query(f"""WITH t AS (SELECT (60000 + event_id % 400 + (event_id % 24) / 24.0::DOUBLE)::DOUBLE AS mjd, event_id FROM events), c AS (SELECT *, UNNEST([{', '.join(f"'{n}'" for n in D.DOODSON)}]) AS constituent FROM t)
  SELECT event_id, constituent, {r(NORM(f'CASE constituent {CASES} END'), 4)} AS arg, {r(f'CASE constituent {FS} ELSE 1 END', 6)} AS f, {r(f'CASE constituent {US} ELSE 0 END', 6)} AS u FROM c""")
def tidal_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    t = table(spark, sf_dir, "events").select("event_id", (60000 + e % 400 + e % 24 / F.lit(24.0)).alias("mjd"))
    return D.tidal_arguments(t).select("event_id", "constituent", rounded("arg", 4).alias("arg"), rounded("f", 6).alias("f"), rounded("u", 6).alias("u"))


@query("""WITH x AS (SELECT DISTINCT (((i % 32) + 32) % 32)::INT AS x FROM (SELECT UNNEST(range(30, 35)) AS i)), y AS (SELECT UNNEST(range(11, 17))::INT AS y),
  d AS (SELECT x, y, pow(least(abs(x + 0.5 - 1.25), 32 - abs(x + 0.5 - 1.25)), 2) + pow(y + 0.5 - 14.0, 2) AS d FROM x, y) SELECT x, y, d FROM d""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = (160.0, 0.0, -150.0, 48.0)  # across the antimeridian
    return D.nearest_tiles(D.tiles_of_box(spark, box, 5), 1.25, 14.0, 5).select("x", "y", "d")


@query(f"""WITH {OBS}, t AS (SELECT floor((lon + 180) / 45)::INT AS x, floor((lat + 90) / 45)::INT AS y, (event_id % 3)::INT AS z, floor(lon / 5 + 0.5) * 5 AS lon, floor(lat / 5 + 0.5) * 5 AS lat, event_id AS v FROM obs WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45),
  k AS (SELECT *, row_number() OVER (PARTITION BY lon, lat ORDER BY z, x, y, v) AS k FROM t WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30) SELECT lon, lat, v FROM k WHERE k = 1""")
def tile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    t = observations(spark, sf_dir).where(lon.between(-90, 90) & lat.between(-45, 45))
    t = t.select(F.floor((lon + 180) / 45).cast("int").alias("x"), F.floor((lat + 90) / 45).cast("int").alias("y"), (F.col("event_id") % 3).cast("int").alias("z"), (F.floor(lon / 5 + 0.5) * 5).alias("lon"), (F.floor(lat / 5 + 0.5) * 5).alias("lat"), F.col("event_id").alias("v"))
    return D.join_tiles(t, (-60.0, -30.0, 60.0, 30.0), 5.0).select((F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat"), "v")


@query("""SELECT l_orderkey, sum(CASE WHEN l_quantity > 40 THEN l_extendedprice ELSE 0 END) AS over_s FROM (SELECT l_orderkey, l_quantity, floor(l_extendedprice)::BIGINT AS l_extendedprice FROM lineitem) GROUP BY 1 HAVING sum(CASE WHEN l_quantity > 40 THEN l_extendedprice ELSE 0 END) > 0""")
def limit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.limit_seconds(table(spark, sf_dir, "lineitem").withColumn("s", F.floor("l_extendedprice").cast("long")), ["l_orderkey"], F.col("l_quantity") > 40, "s")


@query(f"WITH v AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'speed' WHEN 'click' THEN 'temperature' ELSE 'other' END AS quantity, value AS v FROM events) SELECT event_id, {r('''CASE quantity WHEN 'speed' THEN v * 1.943844 WHEN 'temperature' THEN v - 273.15 ELSE v END''', 4)} AS shown, CASE quantity WHEN 'speed' THEN 'kn' WHEN 'temperature' THEN 'C' END AS unit FROM v")
def unit_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "speed").when(F.col("event_type") == "click", "temperature").otherwise("other")
    units = spark.createDataFrame([("speed", "kn", 1.943844, 0.0), ("temperature", "C", 1.0, -273.15)], "quantity string, unit string, factor double, shift double")
    return D.in_units(table(spark, sf_dir, "events").select("event_id", kind.alias("quantity"), F.col("value").alias("v")), units).select("event_id", rounded("shown", 4).alias("shown"), "unit")


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN 'unknown setting' WHEN p_size % 2 = 0 THEN CASE WHEN p_size < 10 THEN 'out of range' END WHEN p_brand NOT IN ('Brand#11', 'Brand#22') THEN 'not an option' END AS problem FROM part""")
def settings_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    key = F.when(s > 45, "z").when(s % 2 == 0, "a").otherwise("b")
    settings = table(spark, sf_dir, "part").select("p_partkey", key.alias("k"), F.when(s % 2 == 0, s.cast("string")).otherwise(F.col("p_brand")).alias("value"))
    specs = spark.createDataFrame([("a", "number", 10.0, 100.0, None), ("b", "enum", None, None, ["Brand#11", "Brand#22"])], "key string, kind string, low double, high double, options array<string>")
    keyed = D.checked_settings(settings.select(F.col("k").alias("key"), "value").distinct(), specs).select(F.col("key").alias("k"), "value", "problem")
    return settings.join(keyed, ["k", "value"]).select("p_partkey", "problem")
