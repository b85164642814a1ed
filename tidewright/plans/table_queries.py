"""Queries over charts, hand-overs, vias and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.angles import rounded
from tidewright.operators import tables as T
from tidewright.plans.base import OBS, collection, observations, r, table

QUERIES, ORACLES, query = collection()


_TRI = "(SELECT n_nationkey AS tri, (n_nationkey * 53 % 300 - 150)::DOUBLE AS x0, (n_nationkey * 31 % 140 - 70)::DOUBLE AS y0, (n_nationkey * 53 % 300 - 150 + 25)::DOUBLE AS x1, (n_nationkey * 31 % 140 - 70 + 4)::DOUBLE AS y1, (n_nationkey * 53 % 300 - 150 + 9)::DOUBLE AS x2, (n_nationkey * 31 % 140 - 70 + 18)::DOUBLE AS y2 FROM nation)"
_S = lambda i, j: f"((x{j} - x{i}) * (lat - y{i}) - (y{j} - y{i}) * (lon - x{i}))"


@query(f"WITH {OBS} SELECT event_id, tri FROM obs, {_TRI} WHERE ({_S(0, 1)} >= 0 AND {_S(1, 2)} >= 0 AND {_S(2, 0)} >= 0) OR ({_S(0, 1)} <= 0 AND {_S(1, 2)} <= 0 AND {_S(2, 0)} <= 0)")
def mesh_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    x, y = n * 53 % 300 - 150, n * 31 % 140 - 70
    tri = table(spark, sf_dir, "nation").select(n.alias("tri"), *(c.cast("double").alias(k) for k, c in (("x0", x), ("y0", y), ("x1", x + 25), ("y1", y + 4), ("x2", x + 9), ("y2", y + 18))))
    points = observations(spark, sf_dir).select("event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return T.in_triangles(points, tri, "event_id", 10.0)


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 7 > 0 THEN (event_id % 23)::DOUBLE END AS depth, floor(value)::BIGINT AS m FROM events)
  SELECT user_id, sum(CASE WHEN depth IS NOT NULL THEN m ELSE 0 END) AS known_m, sum(CASE WHEN depth IS NULL THEN m ELSE 0 END) AS unknown_m, sum(CASE WHEN depth < 3 THEN m ELSE 0 END) AS shallow_m, min(depth) AS least, min(CASE WHEN depth = (SELECT min(depth) FROM s z WHERE z.user_id = s.user_id) THEN event_id END) AS least_at FROM s GROUP BY 1""")
def depth_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = table(spark, sf_dir, "events").select("user_id", e.alias("at"), F.when(e % 7 > 0, (e % 23).cast("double")).alias("depth"), F.floor("value").cast("long").alias("m"))
    return T.depth_check(s, ["user_id"], "depth", "m", 3.0)


@query("""WITH p AS (SELECT user_id, event_id AS a, value < 60 AS narrow, value > 30 AS clear FROM events), m AS (SELECT *, bool_and(clear) OVER w AS stays, bool_or(narrow) OVER w AS bad FROM p WINDOW w AS (PARTITION BY user_id ORDER BY a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT user_id, coalesce(min(CASE WHEN stays AND NOT bad THEN a END), max(a)) AS handover FROM m GROUP BY 1""")
def handover_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.handover(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") < 60, F.col("value") > 30, float("inf"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS a, o_orderkey % 5 = 0 AS own FROM orders), m AS (SELECT *, max(CASE WHEN own THEN a END) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(CASE WHEN own THEN a END) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM o)
  SELECT k, a, own, row_number() OVER (PARTITION BY k ORDER BY a)::INT AS seq FROM m WHERE own OR NOT coalesce(a - p < 500 OR n - a < 500, false)""")
def merge_vias(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("a"))
    return T.merge_vias(o.where("a % 5 = 0"), o.where("a % 5 <> 0"), ["k"], "a", 500.0)


@query("""SELECT event_id, UNNEST(range(greatest(floor(a / 3) * 3, 6)::BIGINT, least(ceil(b / 3) * 3, 120)::BIGINT + 1, 3)) AS step FROM (SELECT event_id, event_id % 140 AS a, event_id % 140 + user_id % 10 AS b FROM events)""")
def aligned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("event_id") % 140
    steps = T.aligned_steps(a, a + F.col("user_id") % 10, F.lit(5), F.lit(121), 3)
    return table(spark, sf_dir, "events").select("event_id", F.explode(steps).alias("step"))


@query("""SELECT event_type AS layer, count(*) AS files, sum(user_id)::BIGINT AS bytes, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, count(*) FILTER (WHERE event_id % 3 <> 0) AS misses FROM events GROUP BY ROLLUP (event_type)""")
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.store_totals(table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.col("user_id").alias("bytes"), (F.col("event_id") % 3 == 0).alias("hit")))


@query("""SELECT p_partkey, 'depth ' || p_size || ' m, wind ' || (p_size * 2) || ' m/s' AS text FROM part""")
def unit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("depth {length:"), F.col("p_size").cast("string"), F.lit("}, wind {speed:"), (F.col("p_size") * 2).cast("string"), F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", T.si_text(text, {"length": "m", "speed": "m/s"}).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'alert' ELSE 'normal' END AS level, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' failed' WHEN o_custkey % 4 > 0 THEN o_orderpriority || ': ' || (o_custkey % 4) || ' left' ELSE o_orderpriority || ' is ready' END AS note FROM orders""")
def end_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    level, note = T.end_note(state, F.col("o_custkey") % 4, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", level.alias("level"), note.alias("note"))


@query()
def leg_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    legs = o.select("event_id", F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + F.col("event_id") % 7 - 3).alias("x1"), (F.col("lat") + F.col("user_id") % 5 - 2).alias("y1"))
    return T.leg_cells(legs, "event_id", 1.0)


@query(f"""WITH {OBS} SELECT event_id, {r('wind', 6)} AS speed, {r('radians(wind_from)', 6)} AS direction, {r('swh', 6)} AS height, {r('mwp', 6)} AS period, {r('radians(mwd)', 6)} AS waves FROM obs""")
def weather_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' numbers, read back from their documents."""
    items = T.weather_items(observations(spark, sf_dir).withColumnRenamed("wind", "wind_ms"))
    paths = {"speed": "wind.speedTrue", "direction": "wind.directionTrue", "height": "water.waveSignificantHeight", "period": "water.wavePeriod", "waves": "water.waveDirection"}
    return items.select("event_id", *(rounded(F.get_json_object("item", f"$.{at}").cast("double"), 6).alias(name) for name, at in paths.items()))
