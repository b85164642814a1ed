"""Queries over time joins, sampling and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.angles import rounded
from tidewright.operators import sampling as S
from tidewright.operators import series as Z
from tidewright.operators import timejoin as T
from tidewright.plans.base import COLS, GRID, HOURLY, OBS, ROWS, collection, hourly, observations, price_grid, r, table

QUERIES, ORACLES, query = collection()


TIES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("""WITH s AS (SELECT *, l_linenumber AS step FROM lineitem WHERE l_linenumber NOT IN (3, 5)),
 d AS (SELECT *, l_extendedprice - lag(l_extendedprice) OVER w AS raw, lag(step) OVER w AS p FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY step, l_partkey, l_suppkey, l_quantity, l_extendedprice))
 SELECT l_orderkey, step, l_partkey, floor(greatest(raw, 0) * 100 + 0.5) / 100.0 AS diff FROM d WHERE p IS NOT NULL""")
def accum_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber not in (3, 5)").withColumnRenamed("l_linenumber", "step")
    return Z.differences(rows, ["l_orderkey"], "step", "l_extendedprice", ties=TIES).select("l_orderkey", "step", "l_partkey", rounded("diff", 2).alias("diff"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third day's count of events, per type, as steps."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", day.alias("day")).agg(F.count("*").cast("double").alias("v")).where("day % 3 = 1").select("event_type", (F.col("day") * 86400).alias("t"), "v")


DAILY = "daily AS (SELECT * FROM (SELECT event_type, floor(epoch(ts) / 86400)::BIGINT * 86400 AS t, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2) WHERE (t // 86400) % 3 = 1)"
BRACKET = f"""WITH {DAILY}, e AS (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS tm FROM events),
  a AS (SELECT e.*, d.t AS p, d.v AS pv FROM e ASOF LEFT JOIN daily d ON e.event_type = d.event_type AND e.tm >= d.t),
  b AS (SELECT a.*, d.t AS n, d.v AS nv FROM a ASOF LEFT JOIN daily d ON a.event_type = d.event_type AND a.tm <= d.t),
  c AS (SELECT event_id, event_type, tm, coalesce(p, n) AS t0, coalesce(n, p) AS t1, coalesce(pv, nv) AS v0, coalesce(nv, pv) AS v1 FROM b),
  w AS (SELECT *, CASE WHEN t1 > t0 THEN greatest(0.0, least(1.0, (tm - t0)::DOUBLE / (t1 - t0))) ELSE 0.0 END AS weight FROM c)"""


def _bracketed(spark: SparkSession, sf_dir: str, grace: float | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("tm"))
    return T.bracket(e, _daily(spark, sf_dir), "tm", "t", ["v"], ["event_type"], grace)


@query(f"{BRACKET} SELECT event_id, t0, t1, {r('weight', 6)} AS weight FROM w")
def asof_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bracketed(spark, sf_dir).select("event_id", "t0", "t1", rounded("weight", 6).alias("weight"))


@query(f"{BRACKET} SELECT event_id, CASE WHEN tm >= t0 - 3600 AND tm <= t1 + 3600 THEN {r('v0 * (1 - weight) + v1 * weight', 4)} END AS v FROM w")
def asof_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bracketed(spark, sf_dir, 3600.0).select("event_id", rounded(T.blend("v_0", "v_1", "weight"), 4).alias("v"))


@query(f"{BRACKET} SELECT event_id, {r('v0 * (1 - weight) + v1 * weight', 4)} AS v, CASE WHEN weight < 0.5 THEN v0 ELSE v1 END AS near FROM w")
def time_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bracketed(spark, sf_dir).select("event_id", rounded(T.blend("v_0", "v_1", "weight"), 4).alias("v"), T.nearer("v_0", "v_1", "weight").alias("near"))


@query("""WITH s AS (SELECT DISTINCT floor(epoch(o_orderdate) / 86400)::BIGINT AS t FROM orders),
  e AS (SELECT DISTINCT floor(epoch(l_shipdate) / 86400)::BIGINT AS tm FROM lineitem), a AS (SELECT tm, t AS p FROM e ASOF LEFT JOIN s ON e.tm >= s.t), b AS (SELECT a.tm, p, t AS n FROM a ASOF LEFT JOIN s ON a.tm <= s.t)
  SELECT tm, coalesce(p, n) AS t0, coalesce(n, p) AS t1 FROM b""")
def asof_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400).cast("long")
    steps = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("t")).distinct()
    tm = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("tm")).distinct()
    return T.bracket(tm, steps, "tm", "t", []).select("tm", "t0", "t1")


@query(f"""WITH {DAILY}, e AS (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS tm FROM events)
  SELECT e.event_id, max(d.v) AS v FROM e LEFT JOIN daily d ON e.event_type = d.event_type AND e.tm <= d.t AND e.tm > d.t - 43200 GROUP BY 1""")
def interval_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("tm"))
    return T.containing(e, _daily(spark, sf_dir).withColumn("len", F.lit(43200)), "tm", "t", "len", ["v"], ["event_type"]).select("event_id", "v")


G = S.Geometry(-80.0, -180.0, 160.0 / (ROWS - 1), 360.0 / COLS, ROWS, COLS, wrap=True)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = G.xy(F.col("lon"), F.col("lat"))
    return observations(spark, sf_dir).select("event_id", x.alias("x"), y.alias("y"))


CORNERS = f"""pts AS (SELECT event_id, (((lon + 180) % 360 + 360) % 360) / {360.0 / COLS!r}::DOUBLE AS x, (lat + 80) / {160.0 / (ROWS - 1)!r}::DOUBLE AS y FROM obs),
  cor AS (SELECT *, floor(x)::INT % {COLS} AS c0, (floor(x)::INT + 1) % {COLS} AS c1, greatest(0, least(floor(y)::INT, {ROWS - 2})) AS r0, x - floor(x) AS tx FROM pts),
  vals AS (SELECT p.event_id, p.x, p.y, tx, greatest(0.0, least(1.0, p.y - r0)) AS ty, a.v AS v00, b.v AS v01, c.v AS v10, d.v AS v11 FROM cor p
    LEFT JOIN g a ON a."row" = r0 AND a.col = c0 LEFT JOIN g b ON b."row" = r0 AND b.col = c1 LEFT JOIN g c ON c."row" = r0 + 1 AND c.col = c0 LEFT JOIN g d ON d."row" = r0 + 1 AND d.col = c1)"""
HOLES = 'g AS (SELECT "row", col, CASE WHEN ("row" * 7 + col * 3) % 11 = 0 THEN NULL ELSE v END AS v FROM grid)'


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_grid(spark, sf_dir).withColumn("v", F.when((F.col("row") * 7 + F.col("col") * 3) % 11 == 0, None).otherwise(F.col("v")))


@query(f"WITH {OBS}, {GRID}, g AS (SELECT * FROM grid), {CORNERS} SELECT event_id, {r('(v00 + tx * (v01 - v00)) + ty * ((v10 + tx * (v11 - v10)) - (v00 + tx * (v01 - v00)))', 4)} AS sample FROM vals")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bilinear(_points(spark, sf_dir), price_grid(spark, sf_dir), G).select("event_id", rounded("sample", 4).alias("sample"))


W = "(CASE WHEN v00 IS NULL THEN 0 ELSE (1 - tx) * (1 - ty) END + CASE WHEN v01 IS NULL THEN 0 ELSE tx * (1 - ty) END + CASE WHEN v10 IS NULL THEN 0 ELSE (1 - tx) * ty END + CASE WHEN v11 IS NULL THEN 0 ELSE tx * ty END)"
SUM = "(coalesce(v00 * ((1 - tx) * (1 - ty)), 0) + coalesce(v01 * (tx * (1 - ty)), 0) + coalesce(v10 * ((1 - tx) * ty), 0) + coalesce(v11 * (tx * ty), 0))"


@query(f"WITH {OBS}, {GRID}, {HOLES}, {CORNERS} SELECT event_id, {r(f'{SUM} / CASE WHEN {W} > 1e-12 THEN {W} END', 4)} AS sample FROM vals")
def bilinear_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bilinear_present(_points(spark, sf_dir), _holed(spark, sf_dir), G).select("event_id", rounded("sample", 4).alias("sample"))


@query(f"""WITH {OBS}, {GRID}, {HOLES.replace("g AS", "h AS", 1)}, o AS (SELECT dr, dc FROM (SELECT UNNEST(range(-2, 3))::INT AS dr), (SELECT UNNEST(range(-2, 3))::INT AS dc) WHERE dr * dr + dc * dc BETWEEN 1 AND 4),
  f AS (SELECT a."row", a.col, sum(b.v * (1.0::DOUBLE / (dr * dr + dc * dc))) / sum(1.0::DOUBLE / (dr * dr + dc * dc)) AS fill FROM h a, o, h b WHERE b."row" = a."row" + dr AND b.col = (a.col + dc + {COLS}) % {COLS} AND b.v IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT h."row", h.col, coalesce(h.v, fill) AS v, (h.v IS NULL AND fill IS NOT NULL)::INT AS filled FROM h LEFT JOIN f ON h."row" = f."row" AND h.col = f.col), {CORNERS},
  marks AS (SELECT p.event_id, coalesce(a.filled, 0) * (1 - tx) * (1 - ty) + coalesce(b.filled, 0) * tx * (1 - ty) + coalesce(c.filled, 0) * (1 - tx) * ty + coalesce(d.filled, 0) * tx * ty > 0 AS filled FROM (SELECT *, greatest(0.0, least(1.0, y - r0)) AS ty FROM cor) p
    LEFT JOIN g a ON a."row" = r0 AND a.col = c0 LEFT JOIN g b ON b."row" = r0 AND b.col = c1 LEFT JOIN g c ON c."row" = r0 + 1 AND c.col = c0 LEFT JOIN g d ON d."row" = r0 + 1 AND d.col = c1)
  SELECT event_id, {r(f'{SUM} / CASE WHEN {W} > 1e-12 THEN {W} END', 4)} AS sample, filled FROM vals JOIN marks USING (event_id)""")
def bilinear_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between cells of a field with holes that near cells fill, over its seam too, and whether a filled one counts."""
    from tidewright.operators.fields import bilinear_filled as filled

    return filled(_points(spark, sf_dir), _holed(spark, sf_dir), G).select("event_id", rounded("sample", 4).alias("sample"), "filled")


@query(f"WITH {OBS}, {GRID}, g AS (SELECT * FROM grid), {CORNERS} SELECT event_id, g.v AS sample FROM pts LEFT JOIN g ON g.\"row\" = greatest(0, least(floor(y + 0.5)::INT, {ROWS - 1})) AND g.col = floor(x + 0.5)::INT % {COLS}")
def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(_points(spark, sf_dir), price_grid(spark, sf_dir), G).select("event_id", "sample")


@query(f"""WITH {GRID}, {HOLES}, o AS (SELECT dr, dc FROM (SELECT UNNEST(range(-2, 3))::INT AS dr), (SELECT UNNEST(range(-2, 3))::INT AS dc) WHERE dr * dr + dc * dc BETWEEN 1 AND 4),
  f AS (SELECT a."row", a.col, sum(b.v * (1.0::DOUBLE / (dr * dr + dc * dc))) / sum(1.0::DOUBLE / (dr * dr + dc * dc)) AS fill FROM g a, o, g b WHERE b."row" = a."row" + dr AND b.col = a.col + dc AND b.v IS NOT NULL GROUP BY 1, 2)
  SELECT g."row", g.col, {r('coalesce(g.v, fill)', 4)} AS v, (g.v IS NULL AND fill IS NOT NULL) AS filled FROM g LEFT JOIN f ON g."row" = f."row" AND g.col = f.col""")
def idw_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fill_idw(_holed(spark, sf_dir)).select("row", "col", rounded("v", 4).alias("v"), "filled")


@query(f"""WITH {GRID}, {HOLES}, o AS (SELECT dr, dc FROM (SELECT UNNEST(range(-3, 4))::INT AS dr), (SELECT UNNEST(range(-3, 4))::INT AS dc) WHERE dr * dr + dc * dc BETWEEN 1 AND 9),
  f AS (SELECT a."row", a.col, b.v * (1 - sqrt(dr * dr + dc * dc) / 3) AS fade, row_number() OVER (PARTITION BY a."row", a.col ORDER BY dr * dr + dc * dc, dr, dc) AS k FROM g a, o, g b WHERE b."row" = a."row" + dr AND b.col = a.col + dc AND b.v IS NOT NULL)
  SELECT g."row", g.col, {r('coalesce(g.v, fade, 0)', 4)} AS v FROM g LEFT JOIN f ON g."row" = f."row" AND g.col = f.col AND k = 1""")
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fill_nearest(_holed(spark, sf_dir)).select("row", "col", rounded("v", 4).alias("v"))


@query(f"WITH {OBS} SELECT event_type, {r('(((degrees(atan2(sum(sin(radians(mwd)) * swh), sum(cos(radians(mwd)) * swh))) % 360) + 360) % 360)', 3)} AS mean_dir FROM obs GROUP BY 1")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.angles import norm360

    a = F.radians("mwd")
    return observations(spark, sf_dir).groupBy("event_type").agg(rounded(norm360(F.degrees(F.atan2(F.sum(F.sin(a) * F.col("swh")), F.sum(F.cos(a) * F.col("swh"))))), 3).alias("mean_dir"))


@query(f"""WITH c AS (SELECT n_regionkey AS site, 1.0 + n_nationkey % 5 AS amp, 14.0 + n_nationkey AS speed, n_nationkey * 10.0 AS arg, n_nationkey * 7.0 AS phase FROM nation), t AS (SELECT r_regionkey AS site, UNNEST(range(0, 240))::INT AS t FROM region)
  SELECT t.site, t.t, {r('sum(amp * cos(radians(speed * t + arg - phase)))', 5)} AS u FROM t JOIN c ON t.site = c.site GROUP BY 1, 2""")
def harmonic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    constituents = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("site"), (1.0 + n % 5).alias("amp"), (14.0 + n).alias("speed"), (n * 10.0).alias("arg"), (n * 7.0).alias("phase"))
    times = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("site"), F.explode(F.sequence(F.lit(0), F.lit(239))).alias("t"))
    return S.harmonic(constituents, times, ["site"]).select("site", "t", rounded("u", 5).alias("u"))


@query("""WITH p AS (SELECT user_id, value AS total, value - (event_id % 5) * 0.5 AS tide FROM events WHERE event_id % 9 <> 0) SELECT user_id, floor(avg(floor((total - tide) * 1000 + 0.5)) * 1000 + 0.5) / 1000000.0 AS shift, count(*) AS samples FROM p GROUP BY 1""")
def msl_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").where("event_id % 9 <> 0").select("user_id", F.col("value").alias("total"), (F.col("value") - F.col("event_id") % 5 * F.lit(0.5)).alias("tide"))
    gap = F.floor((F.col("total") - F.col("tide")) * 1000 + 0.5).cast("double")
    return p.groupBy("user_id").agg((F.floor(F.avg(gap) * 1000 + 0.5) / F.lit(1e6)).alias("shift"), F.count("*").alias("samples"))


COARSE = f"{HOURLY}, s AS (SELECT h, floor(v / 20) AS v FROM hourly)"


@query(f"""WITH {COARSE}, m AS (SELECT *, coalesce(h - lag(h) OVER w > 1, true) AS gap, coalesce(v = lag(v) OVER w, false) AS same FROM s WINDOW w AS (ORDER BY h)),
  q AS (SELECT *, sum(gap::INT) OVER (ORDER BY h) AS part, sum((gap OR NOT same)::INT) OVER (ORDER BY h) AS run FROM m),
  f AS (SELECT part, run, min(h) AS a, max(h) AS b, min(v) AS v FROM q GROUP BY 1, 2), n AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM f WINDOW w AS (PARTITION BY part ORDER BY run))
  SELECT (a + b) / 2.0::DOUBLE AS h, v, CASE WHEN v > p THEN 'high' ELSE 'low' END AS kind FROM n WHERE (v > p AND v > n) OR (v < p AND v < n)""")
def local_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hourly(spark, sf_dir).select(F.lit(0).alias("k"), "h", F.floor(F.col("v") / 20).cast("double").alias("v"))
    return Z.extrema(s, ["k"], "h", "v").select("h", "v", "kind")


@query(f"""WITH {HOURLY}, m AS (SELECT h, v, CASE WHEN lag(h) OVER w = h - 1 THEN lag(v) OVER w END AS p, CASE WHEN lead(h) OVER w = h + 1 THEN lead(v) OVER w END AS n FROM hourly WINDOW w AS (ORDER BY h)),
  k AS (SELECT h, v, p, n, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN (n - p) / 2.0 WHEN n IS NOT NULL THEN n - v WHEN p IS NOT NULL THEN v - p END AS slope,
    CASE WHEN abs(p - 2 * v + n) > 1e-12 THEN greatest(-0.5, least(0.5, (p - n) / (2 * (p - 2 * v + n)))) ELSE 0 END AS dt FROM m)
  SELECT h, {r('slope', 4)} AS slope, CASE WHEN abs(slope) < 2 THEN 'steady' WHEN slope > 0 THEN 'rising' WHEN slope < 0 THEN 'falling' END AS tendency, {r('dt', 4)} AS dt, {r('v - (p - n) * dt / 4', 4)} AS peak FROM k""")
def tide_tendency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy("h")
    s = hourly(spark, sf_dir).select(F.lit(0).alias("k"), "h", "v")
    s = s.withColumns({"p": F.when(F.lag("h").over(w) == F.col("h") - 1, F.lag("v").over(w)), "n": F.when(F.lead("h").over(w) == F.col("h") + 1, F.lead("v").over(w))})
    dt, peak = Z.parabola(F.col("p"), F.col("v"), F.col("n"))
    return Z.tendency(s, ["k"], "h", "v", 2.0).select("h", rounded("slope", 4).alias("slope"), "tendency", rounded(dt, 4).alias("dt"), rounded(peak, 4).alias("peak"))


@query("""WITH m AS (SELECT user_id, event_id, ts, event_type, coalesce(event_type <> lag(event_type) OVER w, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  q AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, run::BIGINT AS run, event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM q GROUP BY 1, 2, 3""")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.collapse_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"""WITH p AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, max(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, min(t) OVER (PARTITION BY user_id) AS s FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
  a AS (SELECT *, UNNEST(generate_series(s + (ceil((t - s) / 21600.0)::BIGINT) * 21600, coalesce(t1 - 1, t), 21600)) AS tm FROM l)
  SELECT user_id, tm AS t, {r('v + (coalesce(v1, v) - v) * coalesce((tm - t)::DOUBLE / (t1 - t), 0)', 4)} AS v FROM a""")
def track_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).agg(F.max("value").alias("v"))
    return Z.resample(p, ["user_id"], "t", ["v"], 21600).select("user_id", "t", rounded("v", 4).alias("v"))


@query("""SELECT o_custkey, o_orderkey, coalesce(bool_or(o_totalprice > 300000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM orders""")
def window_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.skip_after(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", F.col("o_totalprice") > 300000).select("o_custkey", "o_orderkey", "skipped")


@query(f"""WITH {HOURLY}, s AS (SELECT * FROM hourly WHERE h % 5 <> 0), p AS (SELECT event_id, epoch(ts)::DOUBLE / 3600.0 - 473352 AS tm FROM events),
  a AS (SELECT p.*, s.h AS h0, s.v AS v0 FROM p ASOF LEFT JOIN s ON p.tm >= s.h), b AS (SELECT a.*, s.h AS h1, s.v AS v1 FROM a ASOF LEFT JOIN s ON a.tm <= s.h)
  SELECT event_id, CASE WHEN h1 - h0 <= 1 THEN {r('v0 + (v1 - v0) * CASE WHEN h1 > h0 THEN (tm - h0) / (h1 - h0) ELSE 0 END', 3)} END AS sample FROM b""")
def series_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hourly(spark, sf_dir).where("h % 5 <> 0").select(F.lit(0).alias("k"), "h", "v")
    tm = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0 / 3600.0 - 473352
    p = table(spark, sf_dir, "events").select("event_id", F.lit(0).alias("k"), tm.alias("tm"))
    return Z.sample(p, s, ["k"], "h", "v", "tm").select("event_id", rounded("sample", 3).alias("sample"))


@query()
def tide_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrema of the hourly series without ripples under 5 units."""
    s = hourly(spark, sf_dir).select(F.lit(0).alias("k"), "h", "v")
    return Z.prune_extrema(Z.extrema(s, ["k"], "h", "v"), ["k"], "h", "v", "kind", 5.0).select("h", "v", "kind")
