"""Queries over sources, grids, polars, places and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import vessel as V
from tidewright.functions.angles import rounded
from tidewright.operators import coalescing as C
from tidewright.operators import graphs
from tidewright.operators import grids as R
from tidewright.operators import polars as P
from tidewright.operators import spatial as X
from tidewright.plans.base import COLS, GRID, OBS, ROWS, collection, observations, price_grid, r, table

QUERIES, ORACLES, query = collection()


HOUR = "date_trunc('hour', ts)"


def _hour() -> F.Column:
    return F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")


@query(f"""WITH {OBS}, s AS (SELECT user_id, {HOUR} AS hour, event_type, CASE event_type WHEN 'purchase' THEN 10 WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 0 END AS priority, cur, cur_to, event_id FROM obs WHERE cur > 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY priority DESC, event_type DESC, event_id DESC) AS k FROM s) SELECT user_id, hour, cur, cur_to, event_type AS source FROM k WHERE k = 1""")
def priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 2).otherwise(0)
    o = observations(spark, sf_dir).withColumns({"hour": F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"), "p": F.struct(p.alias("priority"), "event_type", "event_id")})
    return C.by_priority(o, ["user_id", "hour"], "p", "event_type", ["cur", "cur_to"], F.col("cur") > 0)


@query(f"""WITH {OBS}, l AS (SELECT event_id, wind, CASE WHEN lat BETWEEN -40 AND 40 THEN wind * 1.1 + 1 END AS a, CASE WHEN lat BETWEEN -10 AND 20 THEN wind * 0.9 + 2 END AS b,
   greatest(0.0, least(1.0, least(lat + 40, 40 - lat) / 5.0)) * greatest(0.0, least(1.0, (event_id % 6) / 3.0)) AS wa, greatest(0.0, least(1.0, least(lat + 10, 20 - lat) / 5.0)) AS wb FROM obs),
  m AS (SELECT *, wind * (1 - CASE WHEN a IS NULL THEN 0 ELSE wa END) + coalesce(a, 0) * CASE WHEN a IS NULL THEN 0 ELSE wa END AS v1 FROM l)
  SELECT event_id, {r('v1 * (1 - CASE WHEN b IS NULL THEN 0 ELSE wb END) + coalesce(b, 0) * CASE WHEN b IS NULL THEN 0 ELSE wb END', 5)} AS wind FROM m""")
def layered_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, wind = F.col("lat"), F.col("wind")
    a, b = F.when(lat.between(-40, 40), wind * 1.1 + 1), F.when(lat.between(-10, 20), wind * 0.9 + 2)
    wa = C.edge_weight(F.least(lat + 40, 40 - lat), (F.col("event_id") % 6).cast("double"))
    wb = C.edge_weight(F.least(lat + 10, 20 - lat), F.lit(3.0))
    return observations(spark, sf_dir).select("event_id", rounded(C.layered(wind, [(a, wa), (b, wb)]), 5).alias("wind"))


@query("SELECT event_type, count(*) AS n, floor(count(*)::DOUBLE / (SELECT count(*) FROM events) * 1e6 + 0.5) / 1e6 AS share FROM events GROUP BY 1")
def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shares(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", rounded("share", 6).alias("share"))


@query("""WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS run, sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey) AS total,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, (k <= 3) AS among_newest FROM w WHERE total <= 1500000 OR run <= 1350000""")
def retention_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    o = table(spark, sf_dir, "orders").withColumn("size", F.floor("o_totalprice").cast("long"))
    newest = C.newest(o, ["o_custkey"], order, 3).select("o_orderkey", F.lit(True).alias("_new"))
    return C.trim_to_size(o, ["o_custkey"], order, "size", 1_500_000).join(newest, "o_orderkey", "left").select("o_custkey", "o_orderkey", F.coalesce("_new", F.lit(False)).alias("among_newest"))


@query("""WITH l AS (SELECT user_id, event_type, max(epoch(ts)) AS last FROM events GROUP BY 1, 2), n AS (SELECT max(epoch(ts)) AS now FROM events)
  SELECT user_id, event_type, CASE WHEN now - (last + 43200) < -1800 THEN 'green' WHEN now - (last + 43200) < 3600 THEN 'orange' ELSE 'red' END AS state FROM l, n""")
def freshness_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    last = e.groupBy("user_id", "event_type").agg(F.max("s").alias("last"))
    return last.crossJoin(e.agg(F.max("s").alias("now"))).select("user_id", "event_type", V.freshness("now", F.col("last") + 43200).alias("state"))


@query("""SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS cycle FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def cycle_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_trunc("day", F.col("o_orderdate")).cast("timestamp_ntz").alias("cycle"), "o_orderpriority")
    return C.complete(o, ["cycle"], o.select("o_orderpriority").distinct())


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def stale_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return C.stale(table(spark, sf_dir, "customer").select("c_custkey"), current, ["c_custkey"])


WATER = f'{GRID}, w AS (SELECT "row", col, (floor(v)::BIGINT % 5 > 1) AS w FROM grid)'


def _water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_grid(spark, sf_dir).select("row", "col", (F.floor("v") % 5 > 1).alias("w"))


@query(f"""WITH {WATER}, o AS (SELECT "row" // 4 AS brow, col // 4 AS bcol, bool_or(w) AS any_water, avg((NOT w)::INT) AS land_fraction FROM w GROUP BY 1, 2),
  e AS (SELECT DISTINCT a."row" // 4 AS brow, a.col // 4 AS bcol FROM w a JOIN w b ON b."row" = a."row" AND b.col = a.col + 1 WHERE a.w AND b.w AND a.col % 4 = 3),
  n AS (SELECT DISTINCT a."row" // 4 AS brow, a.col // 4 AS bcol FROM w a JOIN w b ON b."row" = a."row" + 1 AND b.col = a.col WHERE a.w AND b.w AND a."row" % 4 = 3)
  SELECT o.brow, o.bcol, any_water, floor(land_fraction * 1e6 + 0.5) / 1e6 AS land_fraction, e.brow IS NOT NULL AS east, n.brow IS NOT NULL AS north FROM o LEFT JOIN e ON o.brow = e.brow AND o.bcol = e.bcol LEFT JOIN n ON o.brow = n.brow AND o.bcol = n.bcol""")
def coarse_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coarse(_water(spark, sf_dir), 4, "w").withColumn("land_fraction", rounded("land_fraction", 6))


@query(f"""WITH {GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY "row" // 4, col // 4 ORDER BY v DESC, "row", col) AS k FROM grid) SELECT "row" // 4 AS brow, col // 4 AS bcol, v AS clear, "row" AS at_row, col AS at_col FROM k WHERE k = 1""")
def coarse_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coarse_max(price_grid(spark, sf_dir), 4, "v")


@query(f"""WITH {WATER} SELECT a."row", a.col, bool_or(NOT b.w) AS dilated FROM w a JOIN w b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2""")
def dilate_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = _water(spark, sf_dir).withColumn("land", ~F.col("w"))
    return R.dilate(land, "land", 1, 2).select("row", "col", "dilated")


@query(f"""WITH {GRID}, n AS (SELECT a."row", a.col, a.v, min(b.v) AS lo, max(b.v) AS hi FROM grid a JOIN grid b ON b."row" BETWEEN a."row" - 4 AND a."row" + 4 AND b.col BETWEEN a.col - 4 AND a.col + 4 GROUP BY 1, 2, 3),
  f AS (SELECT a."row", a.col, avg(b.v) AS around FROM grid a JOIN grid b ON b."row" BETWEEN a."row" - 9 AND a."row" + 9 AND b.col BETWEEN a.col - 9 AND a.col + 9 GROUP BY 1, 2)
  SELECT n."row", n.col, v, CASE WHEN v >= hi AND v - around >= 1 THEN 'high' ELSE 'low' END AS kind FROM n JOIN f ON n."row" = f."row" AND n.col = f.col
  WHERE n."row" BETWEEN 1 AND {ROWS - 2} AND n.col BETWEEN 1 AND {COLS - 2} AND ((v >= hi AND v - around >= 1) OR (v <= lo AND around - v >= 1))""")
def pressure_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pressure_extrema(price_grid(spark, sf_dir), "v", ROWS, COLS)


@query(f"""WITH {GRID}, o AS (SELECT UNNEST(range(-4, 5))::INT AS d), k AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS w FROM o),
  full_grid AS (SELECT rr AS "row", cc AS col, coalesce(v, 0) AS v FROM (SELECT UNNEST(range({ROWS}))::INT AS rr) CROSS JOIN (SELECT UNNEST(range({COLS}))::INT AS cc) LEFT JOIN grid ON grid."row" = rr AND grid.col = cc),
  a AS (SELECT g."row", g.col, sum(b.v * w) AS v FROM full_grid g, k, full_grid b WHERE b."row" = g."row" AND b.col = greatest(0, least({COLS - 1}, g.col + d)) GROUP BY 1, 2)
  SELECT g."row", g.col, {r('sum(b.v * w)', 3)} AS blurred FROM a g, k, a b WHERE b.col = g.col AND b."row" = greatest(0, least({ROWS - 1}, g."row" + d)) GROUP BY 1, 2""")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(ROWS * COLS).select(F.floor(F.col("id") / COLS).cast("int").alias("row"), (F.col("id") % COLS).cast("int").alias("col"))
    full = cells.join(price_grid(spark, sf_dir), ["row", "col"], "left").fillna(0.0, ["v"])
    return R.gaussian(full, "v", ROWS, COLS).select("row", "col", rounded("blurred", 3).alias("blurred"))


QUAD = f"""{GRID}, q AS (SELECT a."row", a.col, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM grid a JOIN grid b ON b."row" = a."row" AND b.col = a.col + 1 JOIN grid c ON c."row" = a."row" + 1 AND c.col = a.col + 1 JOIN grid d ON d."row" = a."row" + 1 AND d.col = a.col),
  k AS (SELECT *, (a >= 51000)::INT + (b >= 51000)::INT * 2 + (c >= 51000)::INT * 4 + (d >= 51000)::INT * 8 AS code, (a + b + c + d) / 4 >= 51000 AS m FROM q),
  s AS (SELECT *, CASE WHEN code IN (1, 14) THEN ['ws'] WHEN code IN (2, 13) THEN ['se'] WHEN code IN (3, 12) THEN ['we'] WHEN code IN (4, 11) THEN ['en'] WHEN code IN (6, 9) THEN ['sn'] WHEN code IN (7, 8) THEN ['wn']
    WHEN (code = 5 AND m) OR (code = 10 AND NOT m) THEN ['wn', 'se'] ELSE ['ws', 'en'] END AS segs FROM k WHERE code BETWEEN 1 AND 14), u AS (SELECT *, UNNEST(segs) AS g FROM s),
  p AS (SELECT *, (51000 - a) / (b - a) AS ts, (51000 - b) / (c - b) AS te, (51000 - d) / (c - d) AS tn, (51000 - a) / (d - a) AS tw FROM u)"""
PX = lambda n: f"CASE substr(g, {n}, 1) WHEN 's' THEN col + ts WHEN 'e' THEN col + 1.0 WHEN 'n' THEN col + tn ELSE col END"
PY = lambda n: f"CASE substr(g, {n}, 1) WHEN 's' THEN \"row\" WHEN 'e' THEN \"row\" + te WHEN 'n' THEN \"row\" + 1.0 ELSE \"row\" + tw END"


@query(f'WITH {QUAD} SELECT "row", col, code, {r(PX(1), 5)} AS x0, {r(PY(1), 5)} AS y0, {r(PX(2), 5)} AS x1, {r(PY(2), 5)} AS y1 FROM p')
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.contour_segments(price_grid(spark, sf_dir), "v", 51000.0)
    return s.select("row", "col", "code", *(rounded(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""WITH RECURSIVE {WATER}, c AS (SELECT "row" * 1048576 + col AS id FROM w WHERE NOT w), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON b.id IN (a.id + 1, a.id - 1, a.id + 1048576, a.id - 1048576)),
  t AS (SELECT id, id AS reach FROM c UNION SELECT t.id, e.b FROM t JOIN e ON t.reach = e.a) SELECT (id // 1048576)::INT AS "row", (id % 1048576)::INT AS col, min(reach)::BIGINT AS component FROM t GROUP BY id""")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.components(_water(spark, sf_dir).withColumn("land", ~F.col("w")), "land")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 60 AS a, (o_orderkey // 4) % 60 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  t AS (SELECT 0::BIGINT AS id, 0 AS dist UNION SELECT u.b, t.dist + 1 FROM t JOIN u ON t.id = u.a WHERE t.dist < 60) SELECT id, min(dist) AS dist FROM t GROUP BY 1""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the links of all orders. The SQL's recursion is bound by the number of nodes, which no shortest path reaches."""
    links = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("a"), (F.floor(F.col("o_orderkey") / 4) % 60).alias("b")).distinct()
    return graphs.hops(spark.range(1), links)


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS id, lag(o_orderkey, 1 + (o_custkey % 3)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders), e AS (SELECT o_custkey, max(o_orderkey) AS id FROM orders GROUP BY 1),
  t AS (SELECT e.id AS path, 0 AS seq, e.id FROM e UNION ALL SELECT t.path, t.seq + 1, p.parent FROM t JOIN p ON t.id = p.id WHERE p.parent IS NOT NULL) SELECT path, seq, id FROM t""")
def backtrace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), *(F.lag("o_orderkey", i + 1).over(w).alias(f"p{i}") for i in range(3)))
    steps = o.select("id", F.element_at(F.array("p0", "p1", "p2"), (F.col("o_custkey") % 3 + 1).cast("int")).alias("parent"))
    return graphs.back_trace(steps, o.groupBy("o_custkey").agg(F.max("id").alias("id")))


POLAR = "polar AS (SELECT brand AS polar, twa, tws, floor((30 + sum(p_retailprice) % 7 + tws * 3 + least(twa, 180 - twa) * 0.2) * 100 + 0.5) / 100.0 AS speed FROM (SELECT p_brand AS brand, p_retailprice::BIGINT AS p_retailprice FROM part), (SELECT UNNEST([30, 60, 90, 120, 150, 180])::DOUBLE AS twa), (SELECT UNNEST([4, 8, 12, 16])::DOUBLE AS tws) GROUP BY 1, 2, 3)"


def _polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda *v: F.explode(F.array(*(F.lit(float(x)) for x in v)))
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("polar")).agg((F.sum(F.floor(F.col("p_retailprice") + 0.5).cast("long")) % 7).alias("s"))
    t = brands.withColumn("twa", axis(30, 60, 90, 120, 150, 180)).withColumn("tws", axis(4, 8, 12, 16))
    return t.select("polar", "twa", "tws", (F.floor((30 + F.col("s") + F.col("tws") * 3 + F.least("twa", 180 - F.col("twa")) * 0.2) * 100 + 0.5) / 100.0).alias("speed"), F.lit(True).alias("available"))


@query(f"""WITH {OBS}, {POLAR.replace('p_retailprice::BIGINT', 'floor(p_retailprice + 0.5)::BIGINT')}, q AS (SELECT event_id, 'Brand#' || (event_id % 5 + 1) || (user_id % 5 + 1) AS polar, least((((course - wind_from) % 360) + 360) % 360, 360 - (((course - wind_from) % 360) + 360) % 360) AS a, wind AS tws FROM obs),
  i AS (SELECT q.*, greatest(1, least(5, floor(a / 30)::INT)) * 30.0 AS a0, greatest(1, least(3, floor(tws / 4)::INT)) * 4.0 AS w0 FROM q),
  v AS (SELECT i.*, (a - a0) / 30.0 AS ta, (i.tws - w0) / 4.0 AS tw, s00.speed AS s00, s01.speed AS s01, s10.speed AS s10, s11.speed AS s11 FROM i LEFT JOIN polar s00 ON s00.polar = i.polar AND s00.twa = a0 AND s00.tws = w0 LEFT JOIN polar s01 ON s01.polar = i.polar AND s01.twa = a0 AND s01.tws = w0 + 4
    LEFT JOIN polar s10 ON s10.polar = i.polar AND s10.twa = a0 + 30 AND s10.tws = w0 LEFT JOIN polar s11 ON s11.polar = i.polar AND s11.twa = a0 + 30 AND s11.tws = w0 + 4)
  SELECT event_id, CASE WHEN s00 IS NOT NULL THEN {r('greatest(0, (s00 + tw * (s01 - s00)) + ta * ((s10 + tw * (s11 - s10)) - (s00 + tw * (s01 - s00))))', 4)} END AS speed FROM v""")
def polar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    polar = F.concat(F.lit("Brand#"), (F.col("event_id") % 5 + 1).cast("string"), (F.col("user_id") % 5 + 1).cast("string"))
    q = observations(spark, sf_dir).select("event_id", polar.alias("polar"), (F.col("course") - F.col("wind_from")).alias("twa"), F.col("wind").alias("tws"))
    return P.boat_speed(q, _polar(spark, sf_dir), ["polar"]).select("event_id", rounded("speed", 4).alias("speed"))


@query(f"""WITH {POLAR.replace('p_retailprice::BIGINT', 'floor(p_retailprice + 0.5)::BIGINT')}, a AS (SELECT DISTINCT polar, tws, UNNEST(range(20, 180))::DOUBLE AS twa FROM polar), i AS (SELECT *, greatest(1, least(5, floor(twa / 30)::INT)) * 30.0 AS a0 FROM a),
  v AS (SELECT i.polar, i.tws, i.twa, greatest(0, s0.speed + (i.twa - a0) / 30.0 * (s1.speed - s0.speed)) * abs(cos(radians(i.twa))) AS vmg FROM i JOIN polar s0 ON s0.polar = i.polar AND s0.tws = i.tws AND s0.twa = a0 JOIN polar s1 ON s1.polar = i.polar AND s1.tws = i.tws AND s1.twa = a0 + 30),
  k AS (SELECT *, row_number() OVER (PARTITION BY polar, tws, twa < 90 ORDER BY floor(vmg * 1e9 + 0.5) DESC, twa) AS k FROM v) SELECT polar, tws, max(CASE WHEN twa < 90 THEN twa END) AS beat, max(CASE WHEN twa >= 90 THEN twa END) AS run FROM k WHERE k = 1 GROUP BY 1, 2""")
def polar_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_angles(_polar(spark, sf_dir), ["polar"])


@query(f"""WITH {OBS}, q AS (SELECT event_id, swh AS height, mwp AS period, least((((course - mwd) % 360) + 360) % 360, 360 - (((course - mwd) % 360) + 360) % 360) AS angle FROM obs)
  SELECT event_id, CASE WHEN height <= 4 AND period BETWEEN 4 AND 12 THEN {r('1 - height * 0.05 - period * 0.01 + angle * height * 0.0005', 5)} END AS factor FROM q""")
def wave_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = spark.range(1).select(F.explode(F.array(*map(F.lit, (0.0, 2.0, 4.0)))).alias("height"))
    axes = axes.withColumn("period", F.explode(F.array(*map(F.lit, (4.0, 8.0, 12.0))))).withColumn("angle", F.explode(F.array(*map(F.lit, (0.0, 90.0, 180.0)))))
    layers = axes.withColumn("factor", 1 - F.col("height") * 0.05 - F.col("period") * 0.01 + F.col("angle") * F.col("height") * 0.0005)
    from tidewright.functions.angles import angle_between

    q = observations(spark, sf_dir).select("event_id", F.col("swh").alias("height"), F.col("mwp").alias("period"), angle_between("course", "mwd").alias("angle"))
    return P.wave_factor(q, layers).select("event_id", rounded("factor", 5).alias("factor"))


HAV = "(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(c_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin(radians(c_lon - lon) / 2), 2)))))"


@query(f"""WITH {OBS}, c AS (SELECT n_nationkey, (n_nationkey * 53 % 360 - 180)::DOUBLE AS c_lon, (n_nationkey * 31 % 170 - 85)::DOUBLE AS c_lat, 200000.0 + n_nationkey * 60000 AS radius_m FROM nation) SELECT event_id, n_nationkey FROM obs, c WHERE {HAV} <= radius_m""")
def avoid_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    circles = table(spark, sf_dir, "nation").select("n_nationkey", (n * 53 % 360 - 180).cast("double").alias("c_lon"), (n * 31 % 170 - 85).cast("double").alias("c_lat"), (n * 60000 + 200000.0).alias("radius_m"))
    return X.within_circles(observations(spark, sf_dir), circles, 2_000_000.0).select("event_id", "n_nationkey")


#: A shell with a hole, and a triangle.
RINGS = [(1, [(-60, -30), (50, -40), (70, 45), (-20, 60)]), (1, [(-10, -10), (20, -10), (20, 20), (-10, 20)]), (2, [(100, -60), (160, 0), (110, 50)])]
EDGES = [(p, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for p, ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
EDGE_SQL = "edges(poly, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({p}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for p, a, b, c, d in EDGES) + ")"
EDGE_SCHEMA = "poly int, x0 double, y0 double, x1 double, y1 double"


@query(f"""WITH {OBS}, {EDGE_SQL} SELECT event_id, poly FROM obs, edges WHERE ((y0 > lat) <> (y1 > lat)) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_polygons(observations(spark, sf_dir).select("event_id", "lon", "lat"), spark.createDataFrame(EDGES, EDGE_SCHEMA), "event_id", 5.0)


SIDE = lambda p, q, s: f"(({q[0]} - {p[0]}) * ({s[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({s[0]} - {p[0]}))"
_A, _B, _C, _D = ("lon", "lat"), ("b_lon", "b_lat"), ("x0", "y0"), ("x1", "y1")
_ON = lambda p, q, s: f"({SIDE(p, q, s)} = 0 AND {s[0]} BETWEEN least({p[0]}, {q[0]}) AND greatest({p[0]}, {q[0]}) AND {s[1]} BETWEEN least({p[1]}, {q[1]}) AND greatest({p[1]}, {q[1]}))"


@query(f"""WITH {OBS}, legs AS (SELECT event_id, lon, lat, lon + event_id % 7 - 3 AS b_lon, lat + user_id % 5 - 2 AS b_lat FROM obs), {EDGE_SQL}
  SELECT DISTINCT event_id FROM legs, edges WHERE ({SIDE(_C, _D, _A)} * {SIDE(_C, _D, _B)} < 0 AND {SIDE(_A, _B, _C)} * {SIDE(_A, _B, _D)} < 0) OR {_ON(_C, _D, _A)} OR {_ON(_C, _D, _B)} OR {_ON(_A, _B, _C)} OR {_ON(_A, _B, _D)}""")
def legs_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    legs = o.select("event_id", F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), (F.col("lon") + F.col("event_id") % 7 - 3).alias("b_lon"), (F.col("lat") + F.col("user_id") % 5 - 2).alias("b_lat"))
    return X.legs_touching(legs, spark.createDataFrame(EDGES, EDGE_SCHEMA), "event_id", 5.0)


@query("""SELECT x * 2.0::DOUBLE AS lon, y * 2.0::DOUBLE AS lat FROM (SELECT UNNEST(range(-90, 91)) AS x), (SELECT UNNEST(range(-40, 41)) AS y)""")
def lattice_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lattice_points(spark, (-180.0, -80.0, 180.0, 80.0), 0.5, 20_000).select((F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat"))


@query(f"""WITH {OBS} SELECT event_id, floor((lon + 180) / 45)::INT AS tx, floor((lat + 90) / 45)::INT AS ty FROM obs WHERE lon >= -90 AND lon < 90 AND lat >= -45 AND lat < 45""")
def trim_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    inside = (lon >= -90) & (lon < 90) & (lat >= -45) & (lat < 45)
    return observations(spark, sf_dir).where(inside).select("event_id", F.floor((lon + 180) / 45).cast("int").alias("tx"), F.floor((lat + 90) / 45).cast("int").alias("ty"))


@query()
def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolines of two levels, joined."""
    v = price_grid(spark, sf_dir)
    levels = [R.contour_segments(v, "v", level).withColumn("level", F.lit(level)) for level in (50_000.0, 52_000.0)]
    return R.contour_lines(levels[0].unionByName(levels[1]), ["level"])
