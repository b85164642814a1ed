"""Queries of shores over the driver's tables: nearest places, first hits, fill and refinement, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.angles import rounded
from tidewright.operators import shores
from tidewright.operators.shores import DEGREE_M
from tidewright.plans.base import OBS, collection, observations, r, table
from tidewright.plans.scalars import HAV

QUERIES, ORACLES, query = collection()

CAP = 1_500_000.0


def _ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as places anywhere, near the poles and the date line too."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("place"), (k * 37 % 360 - 180 + (k % 101) * 0.0137).alias("lon"), (k * 53 % 179 - 89 + (k % 89) * 0.00311).alias("lat"))


PORTS = "ports AS (SELECT s_suppkey AS place, (s_suppkey * 37 % 360 - 180 + (s_suppkey % 101) * 0.0137::DOUBLE) AS plon, (s_suppkey * 53 % 179 - 89 + (s_suppkey % 89) * 0.00311::DOUBLE) AS plat FROM supplier)"


@query(f"""WITH {OBS}, {PORTS}, spot AS (SELECT event_id, lon + 0.0123 AS lon, lat + 0.00457 AS lat FROM obs), d AS (SELECT event_id, place, {HAV('lon', 'lat', 'plon', 'plat')} AS m FROM spot, ports)
  SELECT event_id, arg_min(place, m) AS place, {r('min(m)', 1)} AS metres FROM d GROUP BY 1""")
def nearest_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = observations(spark, sf_dir).select("event_id", (F.col("lon") + 0.0123).alias("lon"), (F.col("lat") + 0.00457).alias("lat"))
    near = shores.nearest_places(points, _ports(spark, sf_dir), "event_id")
    return near.select("event_id", "place", rounded("metres", 1).alias("metres"))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as islands: a slanted square each, with a lake. Corners are whole eighths of a degree."""
    k = F.col("s_suppkey")
    x, y, size = (k * 37 % 300 - 150).cast("double"), (k * 53 % 140 - 70).cast("double"), (3 + k % 9).cast("double")
    lake = size * 0.25
    corners = [(x - size, y - 0.5), (x + 0.25, y - size), (x + size, y + 0.75), (x - 0.25, y + size)]
    inner = [(x - lake, y - lake), (x + lake, y - lake), (x + lake, y + lake), (x - lake, y + lake)]
    sides = [F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for ring in (corners, inner) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return table(spark, sf_dir, "supplier").select(k.alias("island"), F.inline(F.array(*sides)))


_RINGS = [[("x - s", "y - 0.5"), ("x + 0.25", "y - s"), ("x + s", "y + 0.75"), ("x - 0.25", "y + s")], [("x - l", "y - l"), ("x + l", "y - l"), ("x + l", "y + l"), ("x - l", "y + l")]]
ISLANDS = f"""island_of AS (SELECT s_suppkey AS island, (s_suppkey * 37 % 300 - 150)::DOUBLE AS x, (s_suppkey * 53 % 140 - 70)::DOUBLE AS y, (3 + s_suppkey % 9)::DOUBLE AS s, (3 + s_suppkey % 9)::DOUBLE * 0.25::DOUBLE AS l FROM supplier),
  sides AS (SELECT island, UNNEST([{', '.join(f"{{'x0': {a[0]}, 'y0': {a[1]}, 'x1': {b[0]}, 'y1': {b[1]}}}" for ring in _RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True))}]) AS e FROM island_of),
  edges AS (SELECT island, e.x0::DOUBLE AS x0, e.y0::DOUBLE AS y0, e.x1::DOUBLE AS x1, e.y1::DOUBLE AS y1 FROM sides)"""


@query(f"""WITH {OBS}, {ISLANDS}, spot AS (SELECT event_id, lon + 0.0123 AS lon, lat + 0.00457 AS lat, course FROM obs), ray AS (SELECT event_id, lon, lat, side, course + turn AS b FROM spot, (VALUES ('left', -90.0::DOUBLE), ('right', 90.0::DOUBLE)) t(side, turn)),
  way AS (SELECT event_id, side, lon, lat, sin(radians(b)) / ({DEGREE_M!r}::DOUBLE * greatest(0.05::DOUBLE, cos(radians(lat)))) AS dx, cos(radians(b)) / {DEGREE_M!r}::DOUBLE AS dy FROM ray),
  seen AS (SELECT event_id, side, dx, dy, ((x0 - lon + 180) % 360 + 360) % 360 - 180 + shift AS ax, y0 - lat AS ay, x1 - x0 AS ex, y1 - y0 AS ey FROM way, edges, (VALUES (-360.0::DOUBLE), (0.0::DOUBLE), (360.0::DOUBLE)) s(shift)
    WHERE greatest(y0, y1) >= least(lat, lat + dy * {CAP}) AND least(y0, y1) <= greatest(lat, lat + dy * {CAP})),
  hit AS (SELECT event_id, side, (ax * ey - ay * ex) / (dx * ey - dy * ex) AS t, (ax * dy - ay * dx) / (dx * ey - dy * ex) AS u FROM seen WHERE dx * ey - dy * ex <> 0),
  best AS (SELECT event_id, min(t) FILTER (side = 'left') AS l, min(t) FILTER (side = 'right') AS r FROM hit WHERE t >= 0 AND t <= {CAP} AND u >= 0 AND u <= 1 GROUP BY 1)
  SELECT event_id, {r('l', 1)} AS "left", {r('r', 1)} AS "right", CASE WHEN l IS NOT NULL OR r IS NOT NULL THEN {r(f'coalesce(l, {CAP}) + coalesce(r, {CAP})', 1)} END AS width FROM spot LEFT JOIN best USING (event_id)""")
def passage_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = observations(spark, sf_dir).select("event_id", (F.col("lon") + 0.0123).alias("lon"), (F.col("lat") + 0.00457).alias("lat"), "course")
    got = shores.passage_widths(points, _islands(spark, sf_dir), "event_id", CAP, 2.0)
    return got.select("event_id", *(rounded(c, 1).alias(c) for c in ("left", "right", "width")))


#: The lattice the islands are drawn on: from 180° W, 88° S on.
WEST, BOTTOM = -180.0, -88.0
_SIDE = "((x1 - x0) * ({y} - y0) - (y1 - y0) * ({x} - x0))"


def _touch(x: str, y: str, size: float) -> str:
    """SQL: an edge has a point in a closed cell."""
    side = ", ".join(_SIDE.format(x=f"({x} + {i})", y=f"({y} + {j})") for i in (0.0, size) for j in (0.0, size))
    return f"(greatest(x0, x1) >= {x} AND least(x0, x1) <= {x} + {size} AND greatest(y0, y1) >= {y} AND least(y0, y1) <= {y} + {size} AND least({side}) <= 0 AND greatest({side}) >= 0)"


def _lattice(name: str, nx: int, ny: int, res: float) -> str:
    return f'{name} AS (SELECT rr::INT AS "row", cc::INT AS col, {WEST} + cc * {res}::DOUBLE AS x, {BOTTOM} + rr * {res}::DOUBLE AS y FROM (SELECT UNNEST(range({ny})) AS rr), (SELECT UNNEST(range({nx})) AS cc))'


def _odd(res: float) -> str:
    """SQL: an edge lies west of a cell's centre, at its height."""
    return f"(((y0 > y + {res / 2}) <> (y1 > y + {res / 2})) AND x0 + (y + {res / 2} - y0) / (y1 - y0) * (x1 - x0) <= x + {res / 2})"


@query(f"""WITH {ISLANDS}, {_lattice('cells', 360, 176, 1.0)},
  met AS (SELECT island, "row", col, count(*) FILTER ({_odd(1.0)}) % 2 = 1 AS inside, bool_or({_touch('x', 'y', 1.0)}) AS border FROM edges JOIN cells ON greatest(y0, y1) >= y AND least(y0, y1) <= y + 1 AND least(x0, x1) <= x + 1 GROUP BY 1, 2, 3)
  SELECT island, "row", col, border FROM met WHERE inside OR border""")
def island_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands with lakes on cells of a degree: inside by scan lines, and what their shores touch."""
    return shores.filled_cells(_islands(spark, sf_dir), "island", WEST, BOTTOM, 1.0, 360, 176)


@query(f"""WITH {ISLANDS}, {', '.join(_lattice(f'c{k}', 45 << k, 22 << k, 8.0 / 2**k) for k in range(3))},
  {', '.join(f'm{k} AS (SELECT DISTINCT "row", col FROM edges JOIN c{k} ON {_touch("x", "y", 8.0 / 2**k)})' for k in range(3))},
  {', '.join(f'''i{k} AS (SELECT DISTINCT "row", col FROM (SELECT "row", col, island FROM edges JOIN c{k} ON least(x0, x1) <= x + {8.0 / 2**k} AND {_odd(8.0 / 2**k)} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1))''' for k in range(3))},
  leaf AS ({' UNION ALL '.join(f'''SELECT {k} AS level, c."row", c.col, i.col IS NOT NULL AS land, FALSE AS border FROM c{k} c LEFT JOIN m{k} m ON m."row" = c."row" AND m.col = c.col LEFT JOIN i{k} i ON i."row" = c."row" AND i.col = c.col {f'JOIN m{k - 1} p ON p."row" = c."row" // 2 AND p.col = c.col // 2' if k else ''} WHERE m.col IS NULL''' for k in range(3))}
    UNION ALL SELECT 2, "row", col, TRUE, TRUE FROM m2)
  SELECT level, "row", col, (SELECT sum((((col::BIGINT << (2 - level)) >> b & 1) << (2 * b)) + ((("row"::BIGINT << (2 - level)) >> b & 1) << (2 * b + 1)))::BIGINT FROM range(10) t(b)) AS code, land, border FROM leaf""")
def island_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The islands on cells of eight degrees, quartered twice where a shore runs."""
    return shores.refined(_islands(spark, sf_dir), "island", WEST, BOTTOM, 8.0, 45, 22, 2, 10_000_000)
