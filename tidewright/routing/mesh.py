"""Chart meshes: triangles with depths and flags, paths over them, and their tables."""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tile file, little-endian. A header of 32 bytes (magic, number of triangles, longitude and latitude of the origin, padding),
# then one array after another: name, type, numbers a triangle. x of a corner is its longitude times the mesh's scale, y its latitude;
# neighbours are ids in the whole mesh, -1 for none; reverse is the shared edge's number on the neighbour's side.
HEADER = "<8sI2d4x"
MAGIC = b"WRPMESH1"
ARRAYS = [
    ("corners", "<f8", 6),
    ("neighbours", "<i4", 3),
    ("cost", "<f4", 1),
    ("depth", "<f4", 1),
    ("clearance", "<f4", 1),
    ("hazard", "<f4", 1),
    ("reverse", "i1", 3),
    ("flags", "u1", 1),
]
# No depth or clearance; no hazard; a hazard of unknown depth.
NO_VALUE, NO_HAZARD, UNKNOWN_HAZARD = -999.0, 1e9, -1e9

TRIANGLES = "tile string, id long, corners array<double>, neighbours array<int>, cost float, depth float, clearance float, hazard float, flags int"


def triangles(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """A row a triangle from spark.read.format("binaryFile") rows, one tile a file. Depths, clearances and hazards that are not there are
    null; a hazard of unknown depth is minus infinity, which no draught clears. index: tile (file name) and first, the id of its
    first triangle; ids count from 0 in each tile without."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("tile"), "content")
    firsts = named.withColumn("first", F.lit(0).cast("long")) if index is None else named.join(index.select("tile", F.col("first").cast("long")), "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, raw, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                magic, n, _, _ = struct.unpack_from(HEADER, raw)
                if magic != MAGIC:
                    raise ValueError(f"{tile} is not a mesh tile")
                at, t = struct.calcsize(HEADER), {}
                for name, kind, width in ARRAYS:
                    flat = np.frombuffer(raw, kind, n * width, at)
                    at, t[name] = at + flat.nbytes, flat.reshape(n, width) if width > 1 else flat
                less = {k: pa.array(t[k], mask=t[k] == NO_VALUE) for k in ("depth", "clearance")}
                hazard = pa.array(np.where(t["hazard"] == np.float32(UNKNOWN_HAZARD), -np.inf, t["hazard"]).astype("f4"), mask=t["hazard"] == np.float32(NO_HAZARD))
                rows = [pa.array([tile] * n), pa.array(np.arange(n) + first), pa.array(t["corners"].tolist(), pa.list_(pa.float64())), pa.array(t["neighbours"].tolist(), pa.list_(pa.int32())), pa.array(t["cost"]), less["depth"], less["clearance"], hazard, pa.array(t["flags"].astype("i4"))]
                yield pa.record_batch(rows, names=[x.split()[0] for x in TRIANGLES.split(", ")])

    return firsts.select("tile", "content", "first").mapInArrow(run, TRIANGLES)


def empty_tiles(tri: DataFrame) -> DataFrame:
    """Tiles none of whose triangles has a depth."""
    return tri.groupBy("tile").agg(F.max("depth").alias("d")).where("d is null").select("tile")


def pieces(tri: DataFrame, usable) -> DataFrame:
    """tile, id, piece: connected usable triangles, over the edges of tiles too, named by the least id. Ids are those of the whole mesh."""
    from tidewright.operators.graphs import connected

    ok = tri.where(usable).select("tile", "id", "neighbours")
    edges = ok.select(F.col("id").alias("a"), F.explode(F.col("neighbours").cast("array<long>")).alias("b")).where("b >= 0")
    edges = edges.join(ok.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return connected(ok.select("id"), edges).join(ok.select("id", "tile"), "id").select("tile", "id", F.col("component").alias("piece"))


class Mesh:
    """Triangles of one or more tiles with ids of their own, neighbour k lying over the edge from corner k to corner k + 1."""

    def __init__(self, corners: np.ndarray, neighbours: np.ndarray, cost: np.ndarray | None = None):
        self.corners, self.neighbours = np.asarray(corners, float).reshape(-1, 3, 2), np.asarray(neighbours)
        self.centre = self.corners.mean(1)
        self.cost = np.ones(len(self.corners)) if cost is None else cost

    def _sides(self, triangles_: np.ndarray | slice, x: float, y: float) -> np.ndarray:
        """Of each triangle's edges, which side the point is on: a row an edge."""
        own = self.corners[triangles_]
        edges, to = np.roll(own, -1, 1) - own, np.array([x, y]) - own
        return (edges[..., 0] * to[..., 1] - edges[..., 1] * to[..., 0]).T

    def _holds(self, t: int, p) -> bool:
        s = self._sides(np.array([t]), *p)
        return bool((s >= -1e-9).all() or (s <= 1e-9).all())

    def locate(self, x: float, y: float) -> int:
        """A triangle that holds the point, −1 if none does."""
        s = self._sides(slice(None), x, y)
        inside = np.flatnonzero((s >= -1e-12).all(0) | (s <= 1e-12).all(0))
        return int(inside[0]) if len(inside) else -1

    def path(self, start: tuple[float, float], goal: tuple[float, float], blocked: np.ndarray) -> list[int] | None:
        """Triangles from start to goal, by A* between the middles of shared edges."""
        s, g = self.locate(*start), self.locate(*goal)
        if s < 0 or g < 0 or blocked[s] or blocked[g]:
            return None
        end, count = np.array(goal), itertools.count()
        at, best, came = {s: np.array(start)}, {s: 0.0}, {}
        heap, done = [(0.0, next(count), s)], set()
        while heap:
            _, _, t = heapq.heappop(heap)
            if t in done:
                continue
            if t == g:
                out = [t]
                while t in came:
                    t = came[t]
                    out.append(t)
                return out[::-1]
            done.add(t)
            for k, n in enumerate(self.neighbours[t].tolist()):
                if n < 0 or blocked[n]:
                    continue
                mid = (self.corners[t, k] + self.corners[t, (k + 1) % 3]) / 2
                d = best[t] + np.hypot(*(mid - at[t])) * self.cost[t]
                if d < best.get(n, np.inf):
                    best[n], came[n], at[n] = d, t, mid
                    heapq.heappush(heap, (d + np.hypot(*(end - mid)), next(count), n))
        return None

    def doors(self, path: list[int]) -> list[np.ndarray]:
        """The edges a path goes through, each with its right end first, as seen on the way."""
        out = []
        for t, n in zip(path, path[1:], strict=False):
            k = int(np.flatnonzero(self.neighbours[t] == n)[0])
            ends = self.corners[t, [k, (k + 1) % 3]]
            (ax, ay), (bx, by) = ends - self.centre[t]
            out.append(ends if ax * by - ay * bx > 0 else ends[::-1])
        return out

    def string(self, start: tuple[float, float], goal: tuple[float, float], path: list[int]) -> list[tuple[float, float]]:
        """The shortest line through a path's triangles. It bends at ends of doors only, so these are the places; a place sees those
        of later doors that lie in the wedge the doors between leave open, and distances are summed up in order of doors."""
        doors = [*self.doors(path), np.array([goal, goal], float)]
        places = [(-1, np.array(start, float))] + [(i, p) for i, d in enumerate(doors) for p in d]
        cost, came = np.full(len(places), np.inf), [-1] * len(places)
        cost[0] = 0.0
        turn = lambda u, v: u[0] * v[1] - u[1] * v[0]
        for at, (own, p) in enumerate(places):
            right = left = None  # the wedge's sides
            for i in range(own + 1, len(doors)):
                ways = doors[i] - p
                for side, way in enumerate(ways):
                    to, slack = 1 + 2 * i + side, 1e-12 * np.hypot(*way)
                    seen = right is None or (turn(right, way) >= -slack and turn(way, left) >= -slack)
                    if seen and cost[at] + np.hypot(*way) < cost[to] - 1e-12:
                        cost[to], came[to] = cost[at] + np.hypot(*way), at
                if not ways.any(1).all():
                    continue  # the place is an end of this door
                if right is None:
                    right, left = ways
                else:
                    right = ways[0] if turn(right, ways[0]) > 0 else right
                    left = ways[1] if turn(ways[1], left) > 0 else left
                if turn(right, left) < 0:
                    break
        line, at = [], len(places) - 1
        while at >= 0:
            if not line or line[-1] != tuple(map(float, places[at][1])):
                line.append(tuple(map(float, places[at][1])))
            at = came[at]
        return line[::-1]

    def grown(self, blocked: np.ndarray, buffer: float) -> np.ndarray:
        """blocked, and triangles any part of which is within `buffer` of an edge they share with a blocked one, as far as they are
        reached over such triangles: from each of these edges, a walk over triangles near it. The mesh's own edge bounds nothing."""
        out = blocked.copy()
        for t, k in np.argwhere(~blocked[:, None] & (self.neighbours >= 0) & blocked[np.maximum(self.neighbours, 0)]).tolist():
            edge = self.corners[t, [k, (k + 1) % 3]]
            todo, met = [t], {t}
            while todo:
                here = todo.pop()
                out[here] = True
                for n in self.neighbours[here].tolist():
                    if n >= 0 and not blocked[n] and n not in met and self._apart(n, edge) <= buffer:
                        met.add(n)
                        todo.append(n)
        return out

    def _apart(self, t: int, edge: np.ndarray) -> float:
        """Distance of a triangle from an edge that does not cross it."""
        own = self.corners[t]

        def nearest(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
            share = np.clip((points - a) @ (b - a) / max((b - a) @ (b - a), 1e-300), 0, 1)
            return float(np.hypot(*(points - a - share[:, None] * (b - a)).T).min())

        return min(nearest(own, *edge), *(nearest(edge, own[k], own[(k + 1) % 3]) for k in range(3)))


def trim_at_circle(line: list[tuple[float, float]], centre: tuple[float, float], radius: float) -> list[tuple[float, float]]:
    """A line up to where it first enters a circle."""
    out = [line[0]]
    for a, b in zip(line, line[1:], strict=False):
        d, f = np.subtract(b, a), np.subtract(a, centre)
        qa, qb, qc = d @ d, 2 * f @ d, f @ f - radius**2
        if qc <= 0:
            return out
        disc = qb * qb - 4 * qa * qc
        if qa > 0 and disc >= 0 and 0 <= (t := (-qb - np.sqrt(disc)) / (2 * qa)) <= 1:
            return [*out, (float(a[0] + t * d[0]), float(a[1] + t * d[1]))]
        out.append(b)
    return out
