"""Water at two levels: parts of water inside coarse cells, links between parts, and triangles near blocked ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.graphs import connected, stored
from tidewright.operators.paths import cell_id

#: Parts a coarse cell may have, as its number leaves room for.
PARTS = 1024


def split_cells(water: DataFrame, k: int) -> DataFrame:
    """row, col, brow, bcol, part, node: each water cell's k x k block, and the part of the block's water it belongs to: cells linked by their
    sides within the block, counted from 1 by their first cell. node: a number for the block and part. What is not listed is land."""
    if k * k > 2 * PARTS:
        raise ValueError(f"blocks of {k} x {k} cells may have more than {PARTS} parts")
    block = lambda c: F.floor(F.col(c) / k).cast("int")
    cells = water.select("row", "col").distinct().withColumns({"id": cell_id(), "brow": block("row"), "bcol": block("col")})
    right = cells.where(F.pmod(F.col("col"), F.lit(k)) < k - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    up = cells.where(F.pmod(F.col("row"), F.lit(k)) < k - 1).select(F.col("id").alias("a"), (F.col("id") + 1048576).alias("b"))
    sides = right.unionByName(up).join(cells.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    parts = connected(cells.select("id"), sides).join(cells, "id")
    first = Window.partitionBy("brow", "bcol").orderBy("component")
    return parts.withColumn("part", F.dense_rank().over(first)).select("row", "col", "brow", "bcol", "part", (cell_id("brow", "bcol") * PARTS + F.col("part")).alias("node"))


def part_links(parts: DataFrame, k: int, cuts: DataFrame | None = None, around: int | None = None) -> DataFrame:
    """a, b: parts of neighbouring blocks with a cell each that share a side. cuts (row, col, side): sides of blocks that are closed, as
    shores.sides_cut() gives them. around: columns of fine cells of a grid around the globe."""
    own = parts.select("row", "col", "brow", "bcol", F.col("node").alias("a"))
    other = parts.select("row", "col", F.col("node").alias("b"))
    east_col = F.col("col") + 1 if around is None else F.pmod(F.col("col") + 1, F.lit(around))
    east = own.where(F.pmod(F.col("col"), F.lit(k)) == k - 1).select("brow", "bcol", "a", "row", east_col.alias("col"), F.lit("east").alias("side"))
    north = own.where(F.pmod(F.col("row"), F.lit(k)) == k - 1).select("brow", "bcol", "a", (F.col("row") + 1).alias("row"), "col", F.lit("north").alias("side"))
    links = east.unionByName(north).join(other, ["row", "col"])
    if cuts is not None:
        links = links.join(cuts.withColumnsRenamed({"row": "brow", "col": "bcol"}), ["brow", "bcol", "side"], "left_anti")
    return links.select("a", "b").distinct()


def _to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Square of the distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    share = ((px - ax) * dx + (py - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))
    share = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    return F.pow(px - ax - share * dx, 2) + F.pow(py - ay - share * dy, 2)


def near_blocked(triangles: DataFrame, buffer: float) -> DataFrame:
    """id, apart: the triangles that are blocked (0), and the others within `buffer` of an edge they or others share with a blocked one, as far
    as they are reached from that edge over triangles within it; apart is the distance to the nearest such edge. triangles: id, corners
    (six numbers), neighbours (neighbour k lies over the edge from corner k to corner k + 1, -1 for none), blocked. The
    mesh's own edge bounds nothing.

    Every edge floods for itself, all of them at once: a row is a triangle and an edge, and a round takes the rows that are new over the
    triangles' sides."""
    corner = lambda i: F.element_at("corners", i)
    free = stored(triangles.where("not blocked").select("id", "corners", F.col("neighbours").cast("array<long>").alias("near")))
    closed = triangles.where("blocked").select(F.col("id").alias("n"))
    sides = free.select("id", "corners", F.posexplode("near").alias("k", "n")).join(closed.distinct(), "n", "left_semi")
    ends = {c: corner((F.col("k") * 2 + d) % 6 + 1) for c, d in (("ax", 0), ("ay", 1), ("bx", 2), ("by", 3))}
    edges = ["edge", "ax", "ay", "bx", "by"]
    new = stored(sides.withColumns(ends).withColumn("edge", F.struct("id", "k")).select("id", *edges, F.lit(0.0).alias("apart")))
    seen = new
    edge = [F.col(c) for c in edges[1:]]
    x, y = [corner(2 * i + 1) for i in range(3)], [corner(2 * i + 2) for i in range(3)]
    near = [_to_segment(x[i], y[i], *edge) for i in range(3)]
    near += [_to_segment(edge[j], edge[j + 1], x[i], y[i], x[(i + 1) % 3], y[(i + 1) % 3]) for i in range(3) for j in (0, 2)]
    rounds = 0
    while not new.isEmpty():
        out = new.join(free.select("id", "near"), "id").select(F.explode("near").alias("id"), *edges).distinct()
        met = out.join(free.select("id", "corners"), "id").withColumn("apart", F.sqrt(F.least(*near))).where(F.col("apart") <= buffer)
        new = stored(met.select("id", *edges, "apart").join(seen.select("id", "edge"), ["id", "edge"], "left_anti"))
        seen, rounds = seen.unionByName(new), rounds + 1
        if rounds % 10 == 0:
            seen = stored(seen)
    reached = seen.groupBy("id").agg(F.min("apart").alias("apart"))
    return reached.unionByName(closed.distinct().select(F.col("n").alias("id"), F.lit(0.0).alias("apart")))
