"""Queries over routes, runs, requests and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.angles import angle_between, rounded
from tidewright.operators import routes as T
from tidewright.operators import series as Z
from tidewright.plans.base import HOURLY, OBS, collection, hourly, observations, r, table
from tidewright.plans.grid_queries import POLAR, _polar
from tidewright.plans.scalars import BEAR, FOLD, HAV

QUERIES, ORACLES, query = collection()


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("""WITH p AS (SELECT *, lag(l_quantity * 60) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS s FROM lineitem)
  SELECT l_orderkey, max(l_quantity) AS max_wind, max(l_discount) AS max_wave, max(l_extendedprice) AS max_index, sum(CASE WHEN l_partkey % 180 < 60 AND l_returnflag <> 'R' THEN coalesce(s, 0) ELSE 0 END) AS upwind_s FROM p GROUP BY 1""")
def departure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").withColumns({"twa": F.col("l_partkey") % 180, "leg_s": F.col("l_quantity") * 60})
    return T.departure_metrics(p, ["l_orderkey"], ORDER, "l_quantity", "l_discount", "l_extendedprice", "twa", "leg_s", F.col("l_returnflag") != "R")


@query("""SELECT l_suppkey, min(v) AS earliest, max(v) AS latest, quantile_disc(v, 0.5) AS median, count(v) AS done, count(*) FILTER (WHERE l_returnflag = 'R') AS left FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1""")
def ensemble_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", F.col("l_returnflag") != "R")


@query("""SELECT o_orderkey, min(l_quantity) AS wind_min, max(l_quantity) AS wind_max, count(l_orderkey) AS samples FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def leg_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy("o_orderkey").agg(F.min("l_quantity").alias("wind_min"), F.max("l_quantity").alias("wind_max"), F.count("l_orderkey").alias("samples"))


@query("""WITH c AS (SELECT event_id, user_id % 7 AS via, floor(value / 20)::BIGINT AS bin, value AS cost, (event_id * 31) % 1009 AS "left" FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY via, bin ORDER BY cost, event_id) AS b, row_number() OVER (PARTITION BY via ORDER BY "left", event_id) AS l FROM c) SELECT event_id, via, bin, cost FROM k WHERE b = 1 OR l = 1""")
def beam_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select("event_id", (F.col("user_id") % 7).alias("via"), F.floor(F.col("value") / 20).cast("long").alias("bin"), F.col("value").alias("cost"), (F.col("event_id") * 31 % 1009).alias("left"))
    return T.beam(c, ["via", "bin"], "cost", "event_id", "left").select("event_id", "via", "bin", "cost")


@query(f"""WITH {OBS}, p AS (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  l AS (SELECT user_id, event_id, CASE WHEN x IS NULL THEN 0 ELSE {HAV('x', 'y', 'lon', 'lat')} END AS m, {BEAR('x', 'y', 'lon', 'lat')} AS c, wind_from FROM p)
  SELECT event_id, {r('m', 2)} AS leg_m, {r('c', 5)} AS course, {r('sum(m) OVER (PARTITION BY user_id ORDER BY event_id)', 1)} AS along_m, {r(FOLD('c - wind_from'), 5)} AS twa FROM l""")
def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.with_legs(observations(spark, sf_dir).drop("course"), ["user_id"], "event_id")
    return p.select("event_id", rounded("leg_m", 2).alias("leg_m"), rounded("course", 5).alias("course"), rounded("along_m", 1).alias("along_m"), rounded(angle_between("course", "wind_from"), 5).alias("twa"))


@query("""WITH m AS (SELECT o_custkey, o_orderkey AS stop, lead(o_orderkey) OVER w AS nxt, row_number() OVER w AS leg, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  SELECT o_custkey, leg::INT AS leg, stop AS "from", nxt AS "to", leg = n - 1 AS is_last FROM m WHERE leg < n""")
def plan_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.plan_legs(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 11 >= event_id % 7 AND event_id % 11 >= event_id % 5 THEN 'genoa' WHEN event_id % 7 >= event_id % 5 THEN 'jib' ELSE 'spinnaker' END AS plan FROM events),
  m AS (SELECT *, coalesce(plan <> lag(plan) OVER (PARTITION BY user_id ORDER BY event_id), true)::INT AS new FROM s), q AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM m)
  SELECT user_id, segment::BIGINT AS segment, plan, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM q GROUP BY 1, 2, 3""")
def sail_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return T.best_plan(table(spark, sf_dir, "events"), ["user_id"], "event_id", {"genoa": e % 11, "jib": e % 7, "spinnaker": e % 5})


@query("""SELECT event_id, concat_ws('; ', CASE WHEN value <= 400 THEN NULL ELSE 'value: at most 400' END, CASE WHEN user_id >= 10 THEN NULL ELSE 'user_id: at least 10' END) AS problems FROM events WHERE NOT (value <= 400 AND user_id >= 10)""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = T.validated(table(spark, sf_dir, "events"), {"value": (F.col("value") <= 400, "at most 400"), "user_id": (F.col("user_id") >= 10, "at least 10")})
    return bad.select("event_id", F.concat_ws("; ", "problems").alias("problems"))


@query("""SELECT event_type, json_extract(props, '$.k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"] % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query(f"""WITH {HOURLY}, t AS (SELECT h, v, lag(v) OVER (ORDER BY h) AS p FROM hourly) SELECT (h // 24)::BIGINT AS day, {r('avg(abs(v - p))', 4)} AS mean_range, {r('max(abs(v - p))', 4)} AS max_range FROM t WHERE p IS NOT NULL GROUP BY 1""")
def tidal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hourly(spark, sf_dir).select(F.lit(0).alias("k"), "h", "v")
    d = Z.differences(s, ["k"], "h", "v", clamp=False).withColumn("range", F.abs("diff"))
    return d.groupBy(F.floor(F.col("h") / 24).alias("day")).agg(rounded(F.avg("range"), 4).alias("mean_range"), rounded(F.max("range"), 4).alias("max_range"))


@query("""WITH c AS (SELECT DISTINCT date_trunc('day', o_orderdate) + INTERVAL 6 HOUR * (o_orderkey % 4) AS cycle FROM orders)
  SELECT cycle, count(*) AS steps, max(s) AS last FROM (SELECT cycle, UNNEST(CASE WHEN hour(cycle) % 12 = 0 THEN list_concat(range(0, 145, 3), range(150, 241, 6)) ELSE range(0, 145, 3) END) AS s FROM c) GROUP BY 1""")
def step_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = F.timestamp_add("HOUR", (F.col("o_orderkey") % 4 * 6).cast("int"), F.date_trunc("day", F.col("o_orderdate")))
    c = table(spark, sf_dir, "orders").select(cycle.cast("timestamp").alias("cycle")).distinct()
    return T.step_ladder(c, 240).groupBy(F.col("cycle").cast("timestamp_ntz").alias("cycle")).agg(F.count("*").alias("steps"), F.max("step_h").alias("last"))


@query("""WITH e AS (SELECT event_id, floor(epoch(ts))::BIGINT AS s FROM events), k AS (SELECT *, floor((s - 27240) / 43200)::BIGINT * 43200 AS a, floor((s - 23220) / 21600)::BIGINT * 21600 AS b FROM e)
  SELECT event_id, greatest(a, CASE WHEN b % 43200 = 0 THEN b - 21600 ELSE b END) AS cycle FROM k""")
def latest_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", T.latest_cycle(s).cast("long").alias("cycle"))


@query("""SELECT p_partkey, sha256(coalesce(p_name, '') || chr(31) || coalesce(p_size::VARCHAR, '') || chr(31) || coalesce(p_type, '')) AS generation FROM part""")
def generation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.generation("p_name", "p_size", "p_type").alias("generation"))


@query("""WITH t AS (SELECT event_id, (event_id % 64)::INT AS f, CASE WHEN event_id % 5 > 0 THEN (event_id % 40)::DOUBLE END AS c, CASE WHEN event_id % 3 > 0 THEN (event_id % 9)::DOUBLE END AS d, CASE WHEN event_id % 7 = 0 THEN (event_id % 6)::DOUBLE END AS z FROM events)
  SELECT event_id, ((f & 1) > 0 OR coalesce(c < 20, false) OR ((f & 2) = 0 AND coalesce(d < 2.5, false)) OR coalesce(z < 2.5, false) OR ((f & 4) > 0 AND (f & 8) = 0 AND (f & 16) = 0) OR (f & 32) > 0) AS blocked FROM t""")
def blocked_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    v = lambda cond, n: F.when(cond, (e % n).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", T.blocked((e % 64).cast("int"), v(e % 5 > 0, 40), v(e % 3 > 0, 9), v(e % 7 == 0, 6), 18.0, 2.0).alias("blocked"))


@query(f"""WITH {OBS} SELECT event_id, floor(CASE WHEN wind < 0 THEN 0 WHEN wind < 8 THEN 0 + wind / 8 * 80 WHEN wind < 16 THEN 80 + (wind - 8) / 8 * 175 ELSE 255 END + 0.5)::INT AS red,
  floor(CASE WHEN wind < 0 THEN 0 WHEN wind < 8 THEN 0 + wind / 8 * 200 WHEN wind < 16 THEN 200 - (wind - 8) / 8 * 150 ELSE 50 END + 0.5)::INT AS green FROM obs""")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, green, _ = T.ramp(F.col("wind"), [(0.0, (0, 0, 90)), (8.0, (80, 200, 60)), (16.0, (255, 50, 20))])
    return observations(spark, sf_dir).select("event_id", red.alias("red"), green.alias("green"))


@query("""WITH k AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part WHERE p_retailprice > 500) SELECT p_brand, p_partkey FROM k WHERE k = 1""")
def regional_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of each source among those that apply."""
    from tidewright.operators.coalescing import newest

    p = table(spark, sf_dir, "part").where("p_retailprice > 500")
    return newest(p, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 1).select("p_brand", "p_partkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list report: newest first, 50 of them."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_totalprice")


@query("""WITH u AS (SELECT s_name AS name, s_acctbal AS v, 2 AS pr FROM supplier UNION ALL SELECT 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0'), c_acctbal, 1 FROM customer),
  k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr DESC, v DESC) AS k FROM u) SELECT name, v, pr AS priority FROM k WHERE k = 1""")
def local_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues merged by name: the local entry replaces the managed one."""
    local = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"), F.lit(2).alias("priority"))
    managed = table(spark, sf_dir, "customer").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0")).alias("name"), F.col("c_acctbal").alias("v"), F.lit(1).alias("priority"))
    w = Window.partitionBy("name").orderBy(F.desc("priority"), F.desc("v"))
    return local.unionByName(managed).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@query(f"""WITH {OBS}, s AS (SELECT * FROM (VALUES ('Gibraltar', -5.6, 35.95), ('Bass', 146.0, -39.5), ('Drake', -65.0, -58.0), ('Dover', 1.4, 51.0)) AS t(name, slon, slat)),
  k AS (SELECT event_id, name, {HAV('lon', 'lat', 'slon', 'slat')} AS m, row_number() OVER (PARTITION BY event_id ORDER BY {HAV('lon', 'lat', 'slon', 'slat')}, name) AS k FROM obs, s) SELECT event_id, name FROM k WHERE k = 1 AND m <= 3000000""")
def strait_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.geodesy import haversine

    straits = [("Gibraltar", -5.6, 35.95), ("Bass", 146.0, -39.5), ("Drake", -65.0, -58.0), ("Dover", 1.4, 51.0)]
    best = F.least(*(F.struct(haversine("lon", "lat", x, y).alias("m"), F.lit(n).alias("name")) for n, x, y in straits))
    return observations(spark, sf_dir).withColumn("b", best).where("b.m <= 3000000").select("event_id", "b.name")


PLACE = "'[' || lon || ',' || lat || ']'"


@query(f"""WITH {OBS}, o AS (SELECT user_id, event_id, lon, lat, {r('wind', 2)} AS wind, swh FROM obs),
  j AS (SELECT user_id, string_agg({PLACE}, ',' ORDER BY event_id) AS line, string_agg('{{"type":"Feature","geometry":{{"type":"Point","coordinates":' || {PLACE} || '}},"properties":{{"wind":' || wind || ',"swh":' || swh || '}}}}', ',' ORDER BY event_id) AS points FROM o GROUP BY 1)
  SELECT user_id, '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || line || ']}}}},' || points || ']}}' AS geojson FROM j""")
def route_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.geojson(observations(spark, sf_dir).withColumn("wind", rounded("wind", 2)), "user_id", "event_id", ["wind", "swh"])


@query(f"""WITH {POLAR.replace('p_retailprice::BIGINT', 'floor(p_retailprice + 0.5)::BIGINT')} SELECT polar, twa, printf('%.1f', twa) || ',' || string_agg(printf('%.2f', {r('speed * 3600 / 1852', 2)}), ',' ORDER BY tws) AS line FROM polar GROUP BY 1, 2""")
def polar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.polar_csv(_polar(spark, sf_dir), "polar", [4.0, 8.0, 12.0, 16.0])


@query()
def departure_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same passage at each of several departures, searched side by side."""
    from tidewright.routing.frames import route_requests
    from tidewright.routing.vessel import Boat

    polar = Boat(9.5, 3.2, 1.8, 5200, 62, 110).polar()
    rows = [(float(a), float(w), float(polar.speed[i, j])) for i, a in enumerate(polar.twa) for j, w in enumerate(polar.tws)]
    n = F.col("n_nationkey")
    requests = table(spark, sf_dir, "nation").select(n.cast("long").alias("route"), F.lit(-5.0).alias("lon0"), F.lit(48.0).alias("lat0"), F.lit(-4.0).alias("lon1"), F.lit(49.2).alias("lat1"), (n * 21600).cast("double").alias("depart"), (4.0 + n % 6).alias("wind_ms"), (n * 29 % 360).cast("double").alias("wind_from"))
    return route_requests(requests.repartition(8), rows, stages=10, bins=10)
