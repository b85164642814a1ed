"""Queries over scalar functions: angles, great circles, tiles, weather and sea state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import angles as A
from tidewright.functions import geodesy as G
from tidewright.functions import meteo as M
from tidewright.functions import vessel as V
from tidewright.plans.base import OBS, collection, observations, r

QUERIES, ORACLES, query = collection()


NORM = lambda x: f"(((({x}) % 360) + 360) % 360)"
WRAP = lambda x: f"((((({x}) + 180) % 360) + 360) % 360 - 180)"
FOLD = lambda x: f"least({NORM(x)}, 360 - {NORM(x)})"
HAV = lambda a, b, c, d: f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2)))))"
BEAR = lambda a, b, c, d: NORM(f"degrees(atan2(sin(radians(({c})-({a}))) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians(({c})-({a})))))")


@query(f"""WITH {OBS} SELECT event_id, {NORM('wind_from * 3 - 720')} AS norm, {WRAP('lon * 2 + 17')} AS wrapped,
  {WRAP('lon - cur_to')} AS lon_off, lon * 3 - 360 * floor((lon * 3 - cur_to) / 360 + 0.5) AS unwrapped,
  {FOLD('wind_from - course')} AS twa FROM obs""")
def angle_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.select("event_id", A.norm360(F.col("wind_from") * 3 - 720).alias("norm"), A.wrap_lon(F.col("lon") * 2 + 17).alias("wrapped"), A.lon_offset("lon", "cur_to").alias("lon_off"), A.unwrap_near(F.col("lon") * 3, "cur_to").alias("unwrapped"), A.twa("course", "wind_from").alias("twa"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return observations(spark, sf_dir).withColumns({"lon0": F.lag("lon").over(w), "lat0": F.lag("lat").over(w)}).where("lon0 is not null")


PAIRS = f"{OBS}, pairs AS (SELECT * FROM (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE lon0 IS NOT NULL)"


@query(f"""WITH {PAIRS} SELECT event_id, {r(HAV('lon0','lat0','lon','lat'), 3)} AS metres, {r(BEAR('lon0','lat0','lon','lat'), 6)} AS bearing FROM pairs""")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("event_id", A.rounded(G.haversine("lon0", "lat0", "lon", "lat"), 3).alias("metres"), A.rounded(G.bearing("lon0", "lat0", "lon", "lat"), 6).alias("bearing"))


@query(f"""WITH {OBS}, d AS (SELECT *, value * 1000 / 6371000.0::DOUBLE AS d FROM obs),
  e AS (SELECT *, asin(greatest(-1, least(1, sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(course))))) AS p2 FROM d)
  SELECT event_id, {r('degrees(p2)', 6)} AS lat2, {r(WRAP('degrees(radians(lon) + atan2(sin(radians(course)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(p2)))'), 6)} AS lon2 FROM e""")
def destination_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon2, lat2 = G.destination("lon", "lat", "course", F.col("value") * 1000)
    return observations(spark, sf_dir).select("event_id", A.rounded(lat2, 6).alias("lat2"), A.rounded(lon2, 6).alias("lon2"))


LINE = (-20.0, 10.0, 40.0, 55.0)


@query(f"""WITH {OBS}, a AS (SELECT *, {HAV(LINE[0], LINE[1], 'lon', 'lat')} / 6371000.0::DOUBLE AS d, radians({BEAR(LINE[0], LINE[1], 'lon', 'lat')} - {BEAR(*LINE)}) AS turn,
   {HAV(LINE[0], LINE[1], 'lon', 'lat')} AS d0, {HAV(LINE[2], LINE[3], 'lon', 'lat')} AS d1, {HAV(*LINE)} AS whole FROM obs),
  b AS (SELECT *, asin(greatest(-1, least(1, sin(d) * sin(turn)))) * 6371000.0::DOUBLE AS xt, atan2(cos(turn) * sin(d), cos(d)) * 6371000.0::DOUBLE AS al FROM a)
  SELECT event_id, {r('xt', 3)} AS cross_m, {r('al', 3)} AS along_m, (least(d0, d1) <= 1000000 OR (abs(xt) <= 1000000 AND al >= 0 AND al <= whole)) AS near FROM b""")
def cross_along_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (*LINE, "lon", "lat")
    return observations(spark, sf_dir).select("event_id", A.rounded(G.cross_track(*args), 3).alias("cross_m"), A.rounded(G.along_track(*args), 3).alias("along_m"), G.segment_within(*args, 1_000_000.0).alias("near"))


@query(f"""WITH {PAIRS}, s AS (SELECT *, UNNEST([0.25, 0.5, 0.75])::DOUBLE AS f, {HAV('lon0','lat0','lon','lat')} / 6371000.0::DOUBLE AS d FROM pairs),
  k AS (SELECT *, CASE WHEN d < 1e-12 THEN 1 - f ELSE sin((1 - f) * d) / sin(d) END AS a, CASE WHEN d < 1e-12 THEN f ELSE sin(f * d) / sin(d) END AS b FROM s),
  v AS (SELECT *, a * cos(radians(lat0)) * cos(radians(lon0)) + b * cos(radians(lat)) * cos(radians(lon)) AS x, a * cos(radians(lat0)) * sin(radians(lon0)) + b * cos(radians(lat)) * sin(radians(lon)) AS y, a * sin(radians(lat0)) + b * sin(radians(lat)) AS z FROM k)
  SELECT event_id, f AS share, CASE WHEN d < 3.141 AND abs(z) < 0.9999 THEN {WRAP(r('degrees(atan2(y, x))', 5))} END AS s_lon, CASE WHEN d < 3.141 THEN {r('degrees(atan2(z, sqrt(x * x + y * y)))', 5)} END AS s_lat FROM v""")
def slerp_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antipodes have no great circle between them, and poles no longitude: null."""
    p = _pairs(spark, sf_dir).withColumn("share", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    lon, lat = G.slerp("lon0", "lat0", "lon", "lat", "share")
    p = p.withColumns({"x": lon, "y": lat, "apart": G.haversine("lon0", "lat0", "lon", "lat") / G.RADIUS < 3.141})
    s_lon = F.when(F.col("apart") & (F.abs(F.sin(F.radians("y"))) < 0.9999), A.wrap_lon(A.rounded("x", 5)))
    return p.select("event_id", "share", s_lon.alias("s_lon"), F.when(F.col("apart"), A.rounded("y", 5)).alias("s_lat"))


MERC = "ln(tan(pi() / 4 + radians(greatest(-85.05112878, least(85.05112878, lat))) / 2))"


@query(f"""WITH {OBS}, z AS (SELECT event_id, lon, lat, UNNEST(range(0, 7))::INT AS z FROM obs)
  SELECT event_id, z, least(pow(2, z) - 1, greatest(0, floor((lon + 180) / 360 * pow(2, z))))::INT AS x, least(pow(2, z) - 1, greatest(0, floor((1 - {MERC} / pi()) / 2 * pow(2, z))))::INT AS y, {r(MERC, 6)} AS merc FROM z""")
def mercator_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = observations(spark, sf_dir).select("event_id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("z"))
    return z.select("event_id", "z", G.tile_x("lon", "z").alias("x"), G.tile_y("lat", "z").alias("y"), A.rounded(G.mercator_y("lat"), 6).alias("merc"))


@query(f"""WITH {OBS} SELECT event_id, (lon >= -10 AND lon <= 40 AND lat BETWEEN 30 AND 60) AS in_europe, ((lon >= 170 OR lon <= -160) AND lat BETWEEN -50 AND 10) AS in_pacific FROM obs
  WHERE (lon >= -10 AND lon <= 40 AND lat BETWEEN 30 AND 60) OR ((lon >= 170 OR lon <= -160) AND lat BETWEEN -50 AND 10)""")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    europe, pacific = (G.bbox_contains(b, "lon", "lat") for b in ((-10, 30, 40, 60), (170, -50, -160, 10)))
    return observations(spark, sf_dir).where(europe | pacific).select("event_id", europe.alias("in_europe"), pacific.alias("in_pacific"))


LADDER = lambda x, bounds: " + ".join(f"(CASE WHEN {x} >= {b} THEN 1 ELSE 0 END)" for b in bounds)


@query(f"WITH {OBS} SELECT ({LADDER('greatest(wind, 0)', M.BEAUFORT)}) AS force, count(*) AS n, max(wind) AS max_wind FROM obs GROUP BY 1")
def beaufort_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(M.beaufort("wind").alias("force")).agg(F.count("*").alias("n"), F.max("wind").alias("max_wind"))


@query(f"WITH {OBS} SELECT ({LADDER('greatest(swh, 0)', M.DOUGLAS)}) AS degree, count(*) AS n, max(swh) AS max_swh FROM obs GROUP BY 1")
def douglas_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(M.douglas("swh").alias("degree")).agg(F.count("*").alias("n"), F.max("swh").alias("max_swh"))


ROUGH = f"""(least(400.0, 50.0 * ((wind * wind + cur * cur - 2 * wind * cur * cos(radians({FOLD('wind_from + 180 - cur_to')}))) / pow(greatest(wind, 0.001), 2)) * greatest(0, least(1, wind / 2.572222)))
  + CASE WHEN swh > 0 THEN 10.0 * swh * swh * (5.0 / greatest(mwp, 5.0)) * (1.0 / greatest(0.3, 1 - 2 * greatest(-(cur * cos(radians({FOLD('mwd + 180 - cur_to')}))), 0) / (9.80665 * greatest(mwp, 2.0) / (4 * pi())))) ELSE 0 END)"""
INDEX = f"{OBS}, idx AS (SELECT *, {r(ROUGH, 1)} AS idx FROM obs)"
BAND = "CASE WHEN idx < 35 THEN 'smooth' WHEN idx < 50 THEN 'good' WHEN idx < 75 THEN 'slight' WHEN idx < 100 THEN 'choppy' WHEN idx < 150 THEN 'rough' ELSE 'extreme' END"


def _index(o: DataFrame) -> DataFrame:
    return o.withColumn("idx", M.sea_state_index("wind", "wind_from", "cur", "cur_to", "swh", "mwp", "mwd"))


@query(f"WITH {INDEX} SELECT date_trunc('hour', ts) AS hour, {BAND} AS band, count(*) AS n, max(idx) AS worst FROM idx GROUP BY 1, 2")
def sea_state_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _index(observations(spark, sf_dir))
    return o.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), M.band("idx").alias("band")).agg(F.count("*").alias("n"), F.max("idx").alias("worst"))


ANG = FOLD("course - mwd")


@query(f"""WITH {INDEX}, e AS (SELECT event_id, {ANG} AS a, idx * (1.05 + 0.25 * cos(radians({ANG}))) AS enc FROM idx)
  SELECT event_id, {r('enc', 4)} AS encounter, CASE WHEN a < 30 THEN 'head' WHEN a < 60 THEN 'bow' WHEN a <= 120 THEN 'beam' WHEN a <= 150 THEN 'quarter' ELSE 'following' END AS sector,
  {r('CASE WHEN enc > 75 THEN 0.5 * least(2.0, (enc - 75) / 100) ELSE 0 END', 6)} AS comfort FROM e""")
def encounter_comfort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _index(observations(spark, sf_dir)).withColumn("enc", M.encounter("idx", "course", "mwd"))
    return o.select("event_id", A.rounded("enc", 4).alias("encounter"), M.sector("course", "mwd").alias("sector"), A.rounded(M.comfort_rate("enc", 0.5), 6).alias("comfort"))


MAGNUS = lambda t: f"exp(17.625 * (({t}) - 273.15) / (243.04 + (({t}) - 273.15)))"


@query(f"""WITH {OBS}, a AS (SELECT event_id, wind, 263.15 + (event_id % 50) AS t, 263.15 + (event_id % 50) - (user_id % 9) AS dew FROM obs),
  b AS (SELECT event_id, wind, (t - 273.15)::DOUBLE AS c, greatest(0, least(1, {MAGNUS('dew')} / {MAGNUS('t')})) AS rh FROM a),
  k AS (SELECT *, c * 9 / 5 + 32 AS f, rh * 100 AS h, pow(wind * 3.6, 0.16) AS v FROM b),
  s AS (SELECT *, CASE WHEN c <= 10 AND wind >= 1.34 THEN 13.12 + 0.6215 * c - 11.37 * v + 0.3965 * c * v END AS chill,
    CASE WHEN c >= 27 AND rh >= 0.4 THEN (-42.379 + 2.04901523 * f + 10.14333127 * h - 0.22475541 * f * h - 0.00683783 * f * f - 0.05481717 * h * h + 0.00122874 * f * f * h + 0.00085282 * f * h * h - 0.00000199 * f * f * h * h
      - CASE WHEN h < 13 AND f >= 80 AND f <= 112 THEN (13 - h) / 4 * sqrt(greatest(0, (17 - abs(f - 95)) / 17)) ELSE 0 END
      + CASE WHEN h > 85 AND f >= 80 AND f <= 87 THEN (h - 85) / 10 * ((87 - f) / 5) ELSE 0 END - 32) * 5 / 9 END AS heat FROM k)
  SELECT event_id, {r('rh', 4)} AS rh, {r('coalesce(chill, heat, c)', 2)} AS feels, CASE WHEN chill IS NOT NULL THEN 'wind_chill' WHEN heat IS NOT NULL THEN 'heat_index' ELSE 'air' END AS basis FROM s""")
def feels_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumn("t", F.lit(263.15) + F.col("event_id") % 50).withColumn("dew", F.col("t") - F.col("user_id") % 9)
    o = o.withColumns({"c": F.col("t") - 273.15, "rh": M.relative_humidity("t", "dew")})
    feels, basis = M.feels_like("c", "wind", "rh")
    return o.select("event_id", A.rounded("rh", 4).alias("rh"), A.rounded(feels, 2).alias("feels"), basis.alias("basis"))


@query(f"""WITH {OBS} SELECT CASE event_id % 14 WHEN 0 THEN 'none' WHEN 1 THEN 'rain' WHEN 3 THEN 'freezing rain' WHEN 5 THEN 'snow' WHEN 6 THEN 'wet snow' WHEN 7 THEN 'rain and snow' WHEN 8 THEN 'ice pellets' WHEN 12 THEN 'freezing drizzle' ELSE 'other' END AS kind, count(*) AS n FROM obs GROUP BY 1""")
def precipitation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(M.precipitation(F.col("event_id") % 14).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, a AS (SELECT event_id, {FOLD('course - wind_from')} AS twa, wind, 2.0 + user_id % 7 AS sp FROM obs),
  b AS (SELECT *, wind * cos(radians(twa)) + sp AS x, wind * sin(radians(twa)) AS y FROM a)
  SELECT event_id, {r('sqrt(x * x + y * y)', 5)} AS aws, {r(FOLD('degrees(atan2(y, x))'), 5)} AS awa FROM b""")
def apparent_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    aws, awa = M.apparent_wind("wind", A.twa("course", "wind_from"), F.lit(2.0) + F.col("user_id") % 7)
    return o.select("event_id", A.rounded(aws, 5).alias("aws"), A.rounded(awa, 5).alias("awa"))


@query(f"""WITH {OBS}, a AS (SELECT *, wind * cos(radians(wind_from)) AS u, wind * sin(radians(wind_from)) AS v, {r(f"cur * cos(radians({FOLD('mwd + 180 - cur_to')}))", 9)} AS along FROM obs)
  SELECT event_id, {NORM(r('270 - degrees(atan2(v, u))', 5))} AS from_deg, {NORM(r('degrees(atan2(u, v))', 5))} AS to_deg, CASE WHEN along <= -0.1 THEN 'opposing' WHEN along >= 0.1 THEN 'following' ELSE 'none' END AS relation FROM a""")
def wind_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles are rounded, then brought into [0, 360): the engines' last bits do not decide whether one is 0 or 360."""
    o = observations(spark, sf_dir).withColumns({"u": F.col("wind") * F.cos(F.radians("wind_from")), "v": F.col("wind") * F.sin(F.radians("wind_from")), "along": A.rounded(F.col("cur") * F.cos(F.radians(A.angle_between(F.col("mwd") + 180, "cur_to"))), 9)})
    return o.select("event_id", A.norm360(A.rounded(M.wind_from("u", "v"), 5)).alias("from_deg"), A.norm360(A.rounded(M.current_to("u", "v"), 5)).alias("to_deg"), M.relation("along").alias("relation"))


@query(f"""WITH {OBS}, a AS (SELECT event_id, ts, {WRAP('wind_from - course')} AS a, {WRAP('wind_from - cur_to')} AS b, wind, 2.5 AS motor, lat, lon FROM obs)
  SELECT event_id, (a * b < 0 AND abs(a) < 180 AND abs(b) < 180) AS tacked, CASE WHEN wind * 0.4 >= 1.5 THEN wind * 0.4 ELSE motor END AS speed, (wind * 0.4 >= 1.5) AS sails,
   CASE WHEN wind * 0.4 >= 1.5 AND event_id % 2 = 0 AND (a * b < 0 AND abs(a) < 180 AND abs(b) < 180) THEN 30.0 ELSE 0.0 END AS charge,
   {r('epoch_us(ts)::DOUBLE / 86400000000.0 + 40587.0', 6)} AS mjd,
   lpad(floor(abs(lat))::INT::VARCHAR, 2, '0') || '°' || lpad(floor((abs(lat) - floor(abs(lat))) * 60)::INT::VARCHAR, 2, '0') || '''' || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || ' ' || lpad(floor(abs(lon))::INT::VARCHAR, 3, '0') || '°' || lpad(floor((abs(lon) - floor(abs(lon))) * 60)::INT::VARCHAR, 2, '0') || '''' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END AS place FROM a""")
def sailing_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tacked = V.tack_between("course", "cur_to", "wind_from")
    speed, sails = V.select_speed(F.col("wind") * 0.4, F.lit(2.5), "sail_max", 1.5)
    return observations(spark, sf_dir).select("event_id", tacked.alias("tacked"), speed.alias("speed"), sails.alias("sails"), V.tack_charge(sails, F.col("event_id") % 2 == 0, tacked).alias("charge"), A.rounded(M.mjd("ts"), 6).alias("mjd"), V.position_text("lat", "lon").alias("place"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, floor(CASE WHEN p_size >= 30 THEN 1.0 ELSE 1.4 - (1.4 - 1) * p_size / 30.0 END::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS coast FROM part""")
def polar_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.plans.base import table

    return table(spark, sf_dir, "part").select("p_partkey", V.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), A.rounded(V.coast_factor(F.col("p_size").cast("double"), 30.0), 6).alias("coast"))
