"""Queries over rows with nulls, unknown keys and positions over the date line: what operators answer where something is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import meteo as M
from tidewright.functions.angles import rounded
from tidewright.functions.geodesy import haversine
from tidewright.operators import coalescing as C
from tidewright.operators import fields as D
from tidewright.operators import polars as P
from tidewright.operators import sampling as S
from tidewright.operators import timejoin as T
from tidewright.plans.base import COLS, GRID, OBS, ROWS, collection, observations, price_grid, r, table
from tidewright.plans.grid_queries import POLAR, _polar
from tidewright.plans.scalars import BAND, BEAR, FOLD, HAV, MAGNUS, ROUGH
from tidewright.plans.series_queries import HOLES, _holed

QUERIES, ORACLES, query = collection()

def _e() -> Column:
    return F.col("event_id")


def _but(c: str, n: int, k: int = 0) -> Column:
    """The column, null in every nth row."""
    return F.when(_e() % n != k, F.col(c))


GAPS = f"""{OBS}, gaps AS (SELECT event_id, course, lon, lat, CASE WHEN event_id % 7 <> 0 THEN wind END AS wind, CASE WHEN event_id % 11 <> 0 THEN wind_from END AS wind_from,
  CASE WHEN event_id % 5 <> 0 THEN cur END AS cur, CASE WHEN event_id % 5 <> 0 THEN cur_to END AS cur_to, CASE WHEN event_id % 13 <> 0 THEN swh END AS swh, CASE WHEN event_id % 17 <> 0 THEN mwp END AS mwp, CASE WHEN event_id % 19 <> 0 THEN mwd END AS mwd FROM obs)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumns({"wind": _but("wind", 7), "wind_from": _but("wind_from", 11), "cur": _but("cur", 5), "cur_to": _but("cur_to", 5), "swh": _but("swh", 13), "mwp": _but("mwp", 17), "mwd": _but("mwd", 19)})


@query(f"""WITH {GAPS}, k AS (SELECT event_id, wind, wind_from, swh, mwp, mwd, coalesce(cur, 0) AS cur, coalesce(cur_to, 0) AS cur_to, swh IS NOT NULL AND mwp IS NOT NULL AND mwd IS NOT NULL AS waves, wind AS own_wind, swh AS own_swh FROM gaps),
  w AS (SELECT event_id, wind, wind_from, cur, cur_to, own_wind, own_swh, waves, CASE WHEN waves THEN swh ELSE 0 END AS swh, CASE WHEN waves THEN mwp ELSE 5 END AS mwp, CASE WHEN waves THEN mwd ELSE 0 END AS mwd FROM k),
  i AS (SELECT event_id, own_wind, own_swh, CASE WHEN wind IS NOT NULL AND wind_from IS NOT NULL THEN {r(ROUGH, 1)} END AS idx FROM w)
  SELECT event_id, idx, CASE WHEN idx IS NOT NULL THEN {BAND} END AS band, CASE WHEN own_wind IS NOT NULL THEN len(list_filter([{', '.join(map(repr, M.BEAUFORT))}]::DOUBLE[], lambda b: b <= own_wind))::INT END AS beaufort,
   CASE WHEN own_swh IS NOT NULL THEN len(list_filter([{', '.join(map(repr, M.DOUGLAS))}]::DOUBLE[], lambda b: b <= own_swh))::INT END AS douglas FROM i""")
def sea_state_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _gaps(spark, sf_dir).withColumn("idx", M.sea_state_index("wind", "wind_from", "cur", "cur_to", "swh", "mwp", "mwd"))
    return o.select("event_id", "idx", M.band("idx").alias("band"), M.beaufort("wind").alias("beaufort"), M.douglas("swh").alias("douglas"))


@query(f"""WITH {OBS}, a AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN wind END AS wind, CASE WHEN event_id % 5 <> 0 THEN 263.15 + (event_id % 50) END AS t, CASE WHEN event_id % 3 <> 0 THEN 263.15 + (event_id % 50) - (user_id % 9) END AS dew,
    CASE WHEN event_id % 4 <> 0 THEN event_id % 14 + (event_id % 8) * 0.1 END AS code FROM obs),
  b AS (SELECT event_id, wind, code, (t - 273.15)::DOUBLE AS c, CASE WHEN t IS NOT NULL AND dew IS NOT NULL THEN greatest(0, least(1, {MAGNUS('dew')} / {MAGNUS('t')})) END AS rh FROM a)
  SELECT event_id, {r('rh', 4)} AS rh, CASE WHEN c IS NULL THEN NULL WHEN c <= 10 AND wind >= 1.34 THEN 'wind_chill' WHEN c >= 27 AND rh >= 0.4 THEN 'heat_index' ELSE 'air' END AS basis,
   CASE WHEN code IS NOT NULL THEN CASE floor(code + 0.5)::INT WHEN 0 THEN 'none' WHEN 1 THEN 'rain' WHEN 3 THEN 'freezing rain' WHEN 5 THEN 'snow' WHEN 6 THEN 'wet snow' WHEN 7 THEN 'rain and snow' WHEN 8 THEN 'ice pellets' WHEN 12 THEN 'freezing drizzle' ELSE 'other' END END AS kind FROM b""")
def weather_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(_e() % 5 != 0, F.lit(263.15) + _e() % 50)
    dew = F.when(_e() % 3 != 0, F.lit(263.15) + _e() % 50 - F.col("user_id") % 9)
    o = observations(spark, sf_dir).withColumns({"wind": _but("wind", 7), "t": t, "dew": dew, "code": F.when(_e() % 4 != 0, _e() % 14 + (_e() % 8) * 0.1)})
    o = o.withColumns({"c": F.col("t") - 273.15, "rh": M.relative_humidity("t", "dew")})
    return o.select("event_id", rounded("rh", 4).alias("rh"), M.feels_like("c", "wind", "rh")[1].alias("basis"), M.precipitation("code").alias("kind"))


#: A crop over the date line, from 165° E to 214° E (146° W).
CROP = S.Geometry(-20.0, 165.0, 1.0, 1.0, ROWS, COLS)
PLACED = f"""{OBS}, {GRID}, p AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (((lon + 180) % 360 + 360) % 360) - 180 END AS lon, CASE WHEN event_id % 10 <> 0 THEN lat END AS lat FROM obs),
  e AS (SELECT event_id, (((lon - 165) % 360) + 360) % 360 AS east, lat + 20 AS y FROM p), x AS (SELECT event_id, CASE WHEN east > 180 THEN east - 360 ELSE east END AS x, y FROM e)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumns({"lon": _but("lon", 9), "lat": _but("lat", 10)})
    x, y = CROP.xy(F.col("lon"), F.col("lat"))
    return o.select("event_id", x.alias("x"), y.alias("y"))


@query(f"""WITH {PLACED}, c AS (SELECT *, greatest(0, least({COLS - 2}, floor(x)::INT)) AS c0, greatest(0, least({ROWS - 2}, floor(y)::INT)) AS r0 FROM x WHERE x IS NOT NULL AND y IS NOT NULL),
  t AS (SELECT *, greatest(0.0, least(1.0, x - c0)) AS tx, greatest(0.0, least(1.0, y - r0)) AS ty FROM c),
  v AS (SELECT t.event_id, (a.v + tx * (b.v - a.v)) + ty * ((c.v + tx * (d.v - c.v)) - (a.v + tx * (b.v - a.v))) AS s FROM t JOIN grid a ON a."row" = r0 AND a.col = c0 JOIN grid b ON b."row" = r0 AND b.col = c0 + 1 JOIN grid c ON c."row" = r0 + 1 AND c.col = c0 JOIN grid d ON d."row" = r0 + 1 AND d.col = c0 + 1),
  n AS (SELECT x.event_id, g.v FROM x JOIN grid g ON g."row" = greatest(0, least({ROWS - 1}, floor(y + 0.5)::INT)) AND g.col = greatest(0, least({COLS - 1}, floor(x + 0.5)::INT)) WHERE x IS NOT NULL AND y IS NOT NULL)
  SELECT x.event_id, {r('s', 4)} AS sample, n.v AS near FROM x LEFT JOIN v ON v.event_id = x.event_id LEFT JOIN n ON n.event_id = x.event_id""")
def date_line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on a crop over the date line; null positions sample nothing."""
    g = price_grid(spark, sf_dir)
    near = S.nearest(S.bilinear(_placed(spark, sf_dir), g, CROP), g, CROP, out="near")
    return near.select("event_id", rounded("sample", 4).alias("sample"), "near")


AROUND = f"""{GRID}, {HOLES}, o AS (SELECT dr, dc FROM (SELECT UNNEST(range(-3, 4))::INT AS dr), (SELECT UNNEST(range(-3, 4))::INT AS dc) WHERE dr * dr + dc * dc BETWEEN 1 AND 9),
  near AS (SELECT a."row", a.col, dr, dc, dr * dr + dc * dc AS d2, b.v FROM g a, o, g b WHERE b."row" = a."row" + dr AND b.col = (a.col + dc + {COLS}) % {COLS} AND b.v IS NOT NULL)"""


@query(f"""WITH {AROUND}, f AS (SELECT "row", col, sum(v * (1.0::DOUBLE / d2)) / sum(1.0::DOUBLE / d2) AS fill FROM near WHERE d2 <= 4 GROUP BY 1, 2), k AS (SELECT "row", col, v * (1 - sqrt(d2) / 3) AS fade, row_number() OVER (PARTITION BY "row", col ORDER BY d2, dr, dc) AS k FROM near)
  SELECT g."row", g.col, {r('coalesce(g.v, fill)', 4)} AS idw, {r('coalesce(g.v, fade, 0)', 4)} AS nearest FROM g LEFT JOIN f ON g."row" = f."row" AND g.col = f.col LEFT JOIN k ON g."row" = k."row" AND g.col = k.col AND k = 1""")
def seam_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells of a grid around the globe, filled over its seam."""
    g = _holed(spark, sf_dir)
    near = S.fill_nearest(g, around=COLS).select("row", "col", rounded("v", 4).alias("nearest"))
    return S.fill_idw(g, around=COLS).join(near, ["row", "col"]).select("row", "col", rounded("v", 4).alias("idw"), "nearest")


BRANDS = POLAR.replace("p_retailprice::BIGINT", "floor(p_retailprice + 0.5)::BIGINT")


@query(f"""WITH {OBS}, {BRANDS}, q AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'none' WHEN event_id % 6 > 1 THEN 'Brand#' || (event_id % 5 + 1) || (user_id % 5 + 1) END AS polar, CASE WHEN event_id % 7 <> 0 THEN {FOLD('course - wind_from')} END AS a, CASE WHEN event_id % 8 <> 0 THEN wind END AS tws FROM obs),
  i AS (SELECT q.*, greatest(1, least(5, floor(a / 30)::INT)) * 30.0 AS a0 FROM q),
  v AS (SELECT i.event_id, i.tws, (a - a0) / 30.0 AS ta, s0.speed AS s0, s1.speed AS s1 FROM i LEFT JOIN polar s0 ON s0.polar = i.polar AND s0.twa = a0 AND s0.tws = 8 AND a IS NOT NULL LEFT JOIN polar s1 ON s1.polar = i.polar AND s1.twa = a0 + 30 AND s1.tws = 8 AND a IS NOT NULL)
  SELECT event_id, CASE WHEN tws IS NOT NULL AND s0 IS NOT NULL THEN {r('greatest(0, s0 + ta * (s1 - s0))', 4)} END AS speed FROM v""")
def polar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polar of one wind speed, with points whose polar is unknown or null, and null angles and winds: every point has its row."""
    polar = F.when(_e() % 6 == 0, "none").when(_e() % 6 > 1, F.concat(F.lit("Brand#"), (_e() % 5 + 1).cast("string"), (F.col("user_id") % 5 + 1).cast("string")))
    q = observations(spark, sf_dir).select("event_id", polar.alias("polar"), F.when(_e() % 7 != 0, F.col("course") - F.col("wind_from")).alias("twa"), _but("wind", 8).alias("tws"))
    return P.boat_speed(q, _polar(spark, sf_dir).where("tws = 8"), ["polar"]).select("event_id", rounded("speed", 4).alias("speed"))


@query(f"""WITH {OBS}, l AS (SELECT event_id, wind, CASE WHEN event_id % 3 <> 0 THEN least(lat + 40, 40 - lat) END AS edge, CASE WHEN event_id % 4 <> 0 THEN 2.0::DOUBLE END AS left_h FROM obs),
  w AS (SELECT event_id, wind, coalesce(greatest(0, least(1, edge / 5.0)) * greatest(0, least(1, left_h / 3.0)), 0) * CASE WHEN edge IS NULL OR left_h IS NULL THEN 0 ELSE 1 END AS w FROM l)
  SELECT event_id, {r('wind * (1 - w) + (wind * 2) * w', 5)} AS wind FROM w""")
def layer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer whose distance to its edge, or time left, is unknown weighs nothing."""
    lat, wind = F.col("lat"), F.col("wind")
    w = C.edge_weight(F.when(_e() % 3 != 0, F.least(lat + 40, 40 - lat)), F.when(_e() % 4 != 0, 2.0))
    return observations(spark, sf_dir).select("event_id", rounded(C.layered(wind, [(wind * 2, w)]), 5).alias("wind"))


@query(f"""WITH {OBS}, p AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN lon END AS lon, lat FROM obs) SELECT event_id, CASE WHEN lon IS NOT NULL THEN {r(HAV('lon', 'lat', '10.0', '50.0'), 1)} END AS metres FROM p""")
def distance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumn("lon", _but("lon", 3))
    return o.select("event_id", rounded(haversine("lon", "lat", F.lit(10.0), F.lit(50.0)), 1).alias("metres"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS k, CASE WHEN event_id % 5 <> 0 THEN floor(epoch(ts))::BIGINT END AS tm FROM events), s AS (SELECT DISTINCT event_type AS k, floor(epoch(ts) / 43200)::BIGINT * 43200 AS t FROM events WHERE event_type <> 'view'),
  a AS (SELECT e.*, s.t AS p FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.tm >= s.t), b AS (SELECT a.*, s.t AS n FROM a ASOF LEFT JOIN s ON a.k = s.k AND a.tm <= s.t) SELECT event_id, coalesce(p, n) AS t0, coalesce(n, p) AS t1 FROM b""")
def asof_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without steps, null keys and null times meet no step."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events")
    e = events.select("event_id", F.when(_e() % 4 != 0, F.col("event_type")).alias("k"), F.when(_e() % 5 != 0, seconds).alias("tm"))
    steps = events.where("event_type <> 'view'").select(F.col("event_type").alias("k"), (F.floor(seconds / 43200) * 43200).alias("t")).distinct()
    return T.bracket(e, steps, "tm", "t", [], ["k"]).select("event_id", "t0", "t1")


SHORE = "shore AS (SELECT (n_nationkey * 37 % 360 - 180)::DOUBLE AS x0, (n_nationkey * 7 % 130 - 65)::DOUBLE AS y0, (n_nationkey * 37 % 360 - 180 + (n_nationkey % 5 - 2) * 1.5)::DOUBLE AS x1, (n_nationkey * 7 % 130 - 65 + n_nationkey % 3)::DOUBLE AS y1 FROM nation)"


@query(f"""WITH {OBS}, {SHORE}, a AS (SELECT event_id, {HAV('x0', 'y0', 'lon', 'lat')} / 6371000.0::DOUBLE AS d, radians({BEAR('x0', 'y0', 'lon', 'lat')} - {BEAR('x0', 'y0', 'x1', 'y1')}) AS turn,
   {HAV('x0', 'y0', 'lon', 'lat')} AS d0, {HAV('x1', 'y1', 'lon', 'lat')} AS d1, {HAV('x0', 'y0', 'x1', 'y1')} AS whole FROM obs, shore),
  b AS (SELECT *, asin(greatest(-1, least(1, sin(d) * sin(turn)))) * 6371000.0::DOUBLE AS xt, atan2(cos(turn) * sin(d), cos(d)) * 6371000.0::DOUBLE AS al FROM a)
  SELECT DISTINCT event_id FROM b WHERE least(d0, d1) <= 300500 OR (abs(xt) <= 300500 AND al >= 0 AND al <= whole)""")
def shore_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions within 300.5 km of a shore's edges, over the date line too."""
    n = F.col("n_nationkey")
    x0, y0 = (n * 37 % 360 - 180).cast("double"), (n * 7 % 130 - 65).cast("double")
    shore = table(spark, sf_dir, "nation").select(x0.alias("x0"), y0.alias("y0"), (x0 + (n % 5 - 2) * 1.5).alias("x1"), (y0 + n % 3).alias("y1"))
    return D.shore_within(observations(spark, sf_dir), shore, "event_id", 300_500.0)
