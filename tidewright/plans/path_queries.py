"""Queries of paths, chart changes, chokepoints and two-level waters over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.angles import rounded
from tidewright.operators import graphs, paths, waters
from tidewright.operators.paths import COAST, DEARER, DEGREE_M
from tidewright.plans.base import COLS, GRID, ROWS, collection, price_grid, table

QUERIES, ORACLES, query = collection()

#: The price grid as water, most of it open: its rows lie a degree apart from 20° S on.
SEA = f'{GRID}, sea AS (SELECT "row", col FROM grid WHERE floor(v)::BIGINT % 5 > 0)'
SOUTH, RES, UNIT = -20.0, 1.0, 0.1


def _sea(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_grid(spark, sf_dir).where(F.floor("v") % 5 > 0).select("row", "col")


MOVES = f"""{SEA}, near AS (SELECT a."row", a.col, {', '.join(f'count(*) FILTER (abs(b."row" - a."row") <= {k} AND abs(b.col - a.col) <= {k}) AS n{k}' for k in range(1, COAST + 1))}
    FROM sea a JOIN sea b ON b."row" BETWEEN a."row" - {COAST} AND a."row" + {COAST} AND b.col BETWEEN a.col - {COAST} AND a.col + {COAST} GROUP BY 1, 2),
  coast AS (SELECT "row", col, CASE {' '.join(f'WHEN n{k} < {(2 * k + 1) ** 2} THEN {k}' for k in range(1, COAST + 1))} ELSE {COAST + 1} END AS c FROM near),
  steps AS (SELECT a."row", a.col, b."row" AS r2, b.col AS c2, b.c, b."row" - a."row" AS dr, b.col - a.col AS dc FROM sea a JOIN coast b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
    WHERE NOT (a."row" = b."row" AND a.col = b.col)),
  open_steps AS (SELECT s.*, cos(radians({SOUTH} + (s."row" + 0.5 + dr / 2.0) * {RES})) AS k FROM steps s LEFT JOIN sea x ON x."row" = s."row" AND x.col = s.c2 LEFT JOIN sea y ON y."row" = s.r2 AND y.col = s.col WHERE dr * dc = 0 OR (x.col IS NOT NULL AND y.col IS NOT NULL)),
  moves AS (SELECT "row"::BIGINT * 1048576 + col AS a, r2::BIGINT * 1048576 + c2 AS b,
    floor(sqrt(dr * dr + dc * dc * k * k) * {RES * DEGREE_M!r}::DOUBLE * (CASE WHEN c > {COAST} THEN 1.0::DOUBLE ELSE 1 + {DEARER}::DOUBLE * ({COAST + 1} - c) / {COAST} END) / {UNIT}::DOUBLE + 0.5)::BIGINT AS cost FROM open_steps)"""
#: One search for each block of 10 x 10 cells, from its first water cell to its last.
SEARCHES = f"""ends AS (SELECT ("row" // 10) * 5 + col // 10 AS block, min("row"::BIGINT * 1048576 + col) AS first, max("row"::BIGINT * 1048576 + col) AS last FROM sea GROUP BY 1),
  searches AS (SELECT block AS search, first AS source, last AS goal FROM ends)"""


@query(f"""WITH RECURSIVE {MOVES}, {SEARCHES},
  found(search, id, cost) USING KEY (search, id) AS (SELECT search, source, 0::BIGINT FROM searches
    UNION (SELECT search, b, min(c) FROM (SELECT f.search, m.b, f.cost + m.cost AS c FROM found f JOIN moves m ON m.a = f.id LEFT JOIN recurring.found r ON r.search = f.search AND r.id = m.b WHERE r.cost IS NULL OR f.cost + m.cost < r.cost) GROUP BY 1, 2)),
  came AS (SELECT f.search, f.id, f.cost, min(CASE WHEN g.cost + m.cost = f.cost THEN m.a END) AS parent FROM found f LEFT JOIN moves m ON m.b = f.id LEFT JOIN found g ON g.search = f.search AND g.id = m.a GROUP BY 1, 2, 3),
  way AS (SELECT s.search, s.goal, c.id, c.cost, c.parent FROM searches s JOIN came c ON c.search = s.search AND c.id = s.goal
    UNION ALL SELECT w.search, w.goal, c.id, c.cost, CASE WHEN c.cost > 0 THEN c.parent END FROM way w JOIN came c ON c.search = w.search AND c.id = w.parent WHERE w.cost > 0)
  SELECT search::BIGINT AS search, goal, row_number() OVER (PARTITION BY search, goal ORDER BY cost) - 1 AS seq, id, cost FROM way""")
def cheapest_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways over water from end to end of the blocks of the grid, all searches side by side, with the cells they go through."""
    sea = graphs.stored(_sea(spark, sf_dir))
    block = (F.floor(F.col("row") / 10) * 5 + F.floor(F.col("col") / 10)).cast("long")
    ends = sea.groupBy(block.alias("search")).agg(F.min(paths.cell_id()).alias("first"), F.max(paths.cell_id()).alias("last"))
    ends = graphs.stored(ends)
    goals = ends.select("search", F.col("last").alias("id"))
    sources = ends.select("search", F.col("first").alias("id"), F.lit(0).cast("long").alias("cost"))
    labels = graphs.stored(paths.cheapest_paths(sources, paths.water_moves(sea, SOUTH, RES, UNIT), goals))
    return paths.traced(labels, goals).withColumn("seq", F.col("seq").cast("long"))


LEGS = """legs AS (SELECT o.o_custkey AS a, l.l_partkey AS b, s.s_nationkey AS chart, ceil(min(l.l_quantity) / 25)::BIGINT AS cost FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE o.o_custkey <> l.l_partkey GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {LEGS}, usable AS (SELECT a AS place, chart FROM legs UNION SELECT b, chart FROM legs), big AS (SELECT sum(cost)::HUGEINT + 1 AS n FROM legs),
  starts AS (SELECT min(c_custkey) AS place FROM customer),
  found(search, place, chart, tot) USING KEY (search, place, chart) AS (SELECT u.place, u.place, u.chart, 0::HUGEINT FROM starts s JOIN usable u ON u.place = s.place
    UNION (SELECT search, place, chart, min(t) FROM (
      SELECT f.search, l.b AS place, l.chart, f.tot + l.cost AS t FROM found f JOIN legs l ON l.a = f.place AND l.chart = f.chart LEFT JOIN recurring.found r ON r.search = f.search AND r.place = l.b AND r.chart = l.chart WHERE r.tot IS NULL OR f.tot + l.cost < r.tot
      UNION ALL SELECT f.search, f.place, u.chart, f.tot + n AS t FROM found f JOIN usable u ON u.place = f.place AND u.chart <> f.chart, big, LATERAL (SELECT 1) LEFT JOIN recurring.found r ON r.search = f.search AND r.place = f.place AND r.chart = u.chart WHERE r.tot IS NULL OR f.tot + n < r.tot) GROUP BY 1, 2, 3)),
  best AS (SELECT search, place, min(tot) AS tot FROM found GROUP BY 1, 2)
  SELECT search, place, (tot // n)::BIGINT AS changes, (tot % n)::BIGINT AS cost FROM best, big""")
def chart_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places linked by what customers ordered, a nation's supplies being a chart: fewest changes from the first customer on."""
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    legs = graphs.stored(lines.where("o_custkey <> l_partkey").groupBy(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b"), F.col("s_nationkey").alias("chart")).agg(F.ceil(F.min("l_quantity") / 25).cast("long").alias("cost")))
    usable = legs.select(F.col("a").alias("place"), "chart").unionByName(legs.select(F.col("b").alias("place"), "chart"))
    ends = table(spark, sf_dir, "customer").agg(F.min("c_custkey").alias("place"))
    starts = ends.join(usable.select("place").distinct(), "place", "left_semi")
    return paths.fewest_changes(starts.select(F.col("place").alias("search"), "place"), legs, usable)[0]


@query()
def chokepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's values as clearance: narrow cells between basins. By the maximum spanning forest; tests hold it against a union-find."""
    cells = price_grid(spark, sf_dir).where(F.floor("v") % 5 > 0).select("row", "col", "v").withColumn("id", paths.cell_id())
    cells = graphs.stored(cells)
    near = cells.select("id", F.explode(F.array((F.col("id") + 1), (F.col("id") + 1048576))).alias("b")).join(cells.select(F.col("id").alias("b")), "b", "left_semi")
    return paths.chokepoints(cells.select("id", F.col("v").alias("clear")), near.select(F.col("id").alias("a"), "b"), 51_000.0, 1.005, 100.0, 50_000.0)


@query(f"""WITH RECURSIVE {SEA}, c AS (SELECT "row"::BIGINT * 1048576 + col AS id FROM sea), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON b.id IN (a.id + 1, a.id - 1, a.id + 1048576, a.id - 1048576)),
  t(id, component) USING KEY (id) AS (SELECT id, id FROM c UNION (SELECT b, min(k) FROM (SELECT e.b, t.component AS k FROM t JOIN e ON e.a = t.id JOIN recurring.t r ON r.id = e.b WHERE t.component < r.component) GROUP BY 1)),
  inside AS (SELECT id, "row" // 4 AS brow, col // 4 AS bcol FROM (SELECT "row", col, "row"::BIGINT * 1048576 + col AS id FROM sea)),
  f(id, part) USING KEY (id) AS (SELECT id, id FROM inside UNION (SELECT b, min(k) FROM (SELECT e.b, f.part AS k FROM f JOIN inside x ON x.id = f.id JOIN e ON e.a = f.id JOIN inside y ON y.id = e.b AND y.brow = x.brow AND y.bcol = x.bcol JOIN recurring.f r ON r.id = e.b WHERE f.part < r.part) GROUP BY 1))
  SELECT brow::INT AS brow, bcol::INT AS bcol, dense_rank() OVER (PARTITION BY brow, bcol ORDER BY part)::INT AS part, cells, component FROM (SELECT brow, bcol, part, count(*) AS cells, min(component) AS component FROM inside i JOIN f ON f.id = i.id JOIN t ON t.id = i.id GROUP BY 1, 2, 3)""")
def split_waters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of water in blocks of 4 x 4 cells, and the water each belongs to, named by its first cell: found over parts alone."""
    parts = graphs.stored(waters.split_cells(_sea(spark, sf_dir), 4))
    nodes = parts.groupBy("node", "brow", "bcol", "part").agg(F.count("*").alias("cells"), F.min(paths.cell_id()).alias("first"))
    label = graphs.connected(parts.select(F.col("node").alias("id")).distinct(), waters.part_links(parts, 4))
    joined = graphs.stored(nodes.join(label.withColumnRenamed("id", "node"), "node"))
    names = joined.groupBy("component").agg(F.min("first").alias("name"))
    return joined.join(names, "component").select("brow", "bcol", "part", "cells", F.col("name").alias("component"))


@query()
def buffered_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's cells as two triangles each, blocked where the value is low; those within 1.25 cells of what is blocked. Tests hold it
    against a walk from each edge."""
    g = price_grid(spark, sf_dir).withColumns({"blocked": F.floor("v") % 11 == 0, "half": F.explode(F.array(F.lit(0), F.lit(1)))})
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    lower = F.array(x, y, x + 1, y, x + 1, y + 1)
    upper = F.array(x, y, x + 1, y + 1, x, y + 1)
    number = lambda r, c, h: ((r * COLS + c) * 2 + h).cast("int")
    row, col_ = F.col("row"), F.col("col")
    near_lower = F.array(F.when(row > 0, number(row - 1, col_, 1)).otherwise(-1), F.when(col_ < COLS - 1, number(row, col_ + 1, 1)).otherwise(-1), number(row, col_, 1))
    near_upper = F.array(number(row, col_, 0), F.when(row < ROWS - 1, number(row + 1, col_, 0)).otherwise(-1), F.when(col_ > 0, number(row, col_ - 1, 0)).otherwise(-1))
    is_lower = F.col("half") == 0
    tri = g.select(number(row, col_, F.col("half")).cast("long").alias("id"), F.when(is_lower, lower).otherwise(upper).alias("corners"), F.when(is_lower, near_lower).otherwise(near_upper).alias("neighbours"), "blocked")
    return waters.near_blocked(graphs.stored(tri), 1.25).withColumn("apart", rounded("apart", 6))
