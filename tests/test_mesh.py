import struct

import numpy as np
from pyspark.sql import functions as F

from tidewright.routing import corridor, geo, mesh


def grid(n):
    """n x n unit squares, two triangles each: neighbour k over the edge from corner k to corner k + 1."""
    corners, index = [], {}
    for y in range(n):
        for x in range(n):
            index[x, y, 0], index[x, y, 1] = len(corners), len(corners) + 1
            corners += [[(x, y), (x + 1, y), (x + 1, y + 1)], [(x, y), (x + 1, y + 1), (x, y + 1)]]
    near = []
    for y in range(n):
        for x in range(n):
            near.append([index.get((x, y - 1, 1), -1), index.get((x + 1, y, 1), -1), index[x, y, 1]])
            near.append([index[x, y, 0], index.get((x, y + 1, 0), -1), index.get((x - 1, y, 0), -1)])
    return np.array(corners, float), np.array(near), index


def test_path_and_string_around_a_block():
    corners, near, index = grid(6)
    m = mesh.Mesh(corners, near)
    blocked = np.zeros(len(corners), bool)
    for y in range(5):
        blocked[[index[3, y, 0], index[3, y, 1]]] = True
    path = m.path((0.5, 0.4), (5.5, 0.4), blocked)
    assert path and not blocked[path].any()
    line = m.string((0.5, 0.4), (5.5, 0.4), path)
    assert line[0] == (0.5, 0.4) and line[-1] == (5.5, 0.4) and (3.0, 5.0) in line and (4.0, 5.0) in line
    metres = lambda p: sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:], strict=False))
    best = metres([(0.5, 0.4), (3, 5), (4, 5), (5.5, 0.4)])
    assert best <= metres(line) < 1.05 * best  # the channel of triangles is found by their middles
    clear = m.path((0.2, 0.1), (5.8, 5.7), np.zeros(len(corners), bool))
    assert len(m.string((0.2, 0.1), (5.8, 5.7), clear)) == 2
    wall = blocked.copy()
    wall[[index[3, 5, 0], index[3, 5, 1]]] = True
    assert m.path((0.5, 0.4), (5.5, 0.4), wall) is None and m.path((9, 9), (1, 1), wall) is None
    grown = m.grown(blocked, 0.6)
    assert grown[index[2, 2, 0]] and grown[index[4, 2, 1]] and not grown[index[1, 2, 0]]
    assert m.locate(2.7, 2.2) == index[2, 2, 0]


def test_tiles_are_tables(spark, tmp_path):
    corners, near, index = grid(3)
    depth = np.full(18, 5.0, "f4")
    depth[[index[1, y, k] for y in range(3) for k in (0, 1)]] = -999.0
    def tile(near, depth):
        """A tile file, written field by field."""
        out = b"WRPMESH1" + struct.pack("<Idd", 18, -5.0, 48.0) + bytes(4)
        out += struct.pack("<108d", *corners.ravel()) + struct.pack("<54i", *near.ravel().tolist()) + struct.pack("<18f", *[1.0] * 18)
        out += struct.pack("<18f", *depth) + struct.pack("<18f", *[40.0] * 18) + struct.pack("<18f", *[1e9] * 16, -1e9, 3.5)
        return out + struct.pack("<54b", *[0] * 54) + struct.pack("<18B", *range(111, 129))

    (tmp_path / "a.tri").write_bytes(tile(near, depth))
    (tmp_path / "b.tri").write_bytes(tile(np.where(near < 0, near, near + 18), np.full(18, -999.0)))
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.tri"))
    tri = mesh.triangles(files, spark.createDataFrame([("a.tri", 0), ("b.tri", 18)], "tile string, first long")).cache()
    assert sorted(r.id for r in tri.collect()) == list(range(36)) and [r.tile for r in mesh.empty_tiles(tri).collect()] == ["b.tri"]
    last = {r.id: r for r in tri.where("tile = 'b.tri'").collect()}
    assert last[33].hazard is None and last[34].hazard == float("-inf") and last[35].hazard == 3.5 and last[35].flags == 128 and last[35].clearance == 40.0 and last[35].depth is None
    assert np.allclose(last[18].corners, corners[0].ravel()) and last[18].neighbours == np.where(near[0] < 0, near[0], near[0] + 18).tolist()
    found = mesh.pieces(tri, F.col("depth").isNotNull())
    assert found.groupBy("tile", "piece").count().count() == 2 and found.count() == 12
    assert mesh.triangles(files).where("tile = 'b.tri'").agg(F.min("id"), F.max("id")).first()[:] == (0, 17)


def test_string_is_the_shortest_line():
    """Against Dijkstra over all corners of the channel, two of which see each other if the line between stays in the channel."""
    rng = np.random.default_rng(1)
    corners, near, index = grid(5)
    m = mesh.Mesh(corners, near)
    for seed in range(6):
        blocked = np.zeros(len(corners), bool)
        blocked[rng.choice(len(corners), 14, replace=False)] = True
        start, goal = (0.3, 0.1), (4.7, 4.9)
        blocked[[m.locate(*start), m.locate(*goal)]] = False
        if (path := m.path(start, goal, blocked)) is None:
            continue
        places = [start, *sorted({tuple(p) for t in path for p in corners[t]}), goal]
        inside = lambda p: any(m._holds(t, p) for t in path)
        sees = lambda a, b: all(inside(np.add(a, np.multiply(np.subtract(b, a), x))) for x in np.linspace(0, 1, 203))
        d = {p: np.inf for p in places} | {start: 0.0}
        todo = set(places)
        while todo:
            p = min(todo, key=d.get)
            todo.discard(p)
            for q in todo:
                if d[p] + np.hypot(*np.subtract(q, p)) < d[q] and sees(p, q):
                    d[q] = d[p] + np.hypot(*np.subtract(q, p))
        line = m.string(start, goal, path)
        assert line[0] == start and line[-1] == goal
        assert abs(sum(np.hypot(*np.subtract(b, a)) for a, b in zip(line, line[1:], strict=False)) - d[goal]) < 1e-9


def test_buffer_by_brute_force():
    corners, near, index = grid(6)
    m = mesh.Mesh(corners, near)
    blocked = np.zeros(len(corners), bool)
    blocked[[index[3, 3, 0], index[3, 3, 1]]] = True
    dense = lambda t: np.array([(1 - a) * ((1 - b) * corners[t, 0] + b * corners[t, 1]) + a * corners[t, 2] for a in np.linspace(0, 1, 21) for b in np.linspace(0, 1, 21)])
    square = np.array([(x, y) for x in np.linspace(3, 4, 41) for y in np.linspace(3, 4, 41)])
    apart = [np.hypot(*(dense(t)[:, None] - square[None]).transpose(2, 0, 1)).min() for t in range(len(corners))]
    for buffer in (0.5, 1.2, 1.9):
        assert (m.grown(blocked, buffer) == (np.array(apart) <= buffer)).all()
    assert not m.grown(np.zeros(len(corners), bool), 5.0).any()  # the mesh's own edge bounds nothing


def test_trim_at_circle():
    assert mesh.trim_at_circle([(0, 0), (10, 0), (20, 0)], (20, 0), 4.0) == [(0, 0), (10, 0), (16.0, 0.0)]
    assert mesh.trim_at_circle([(0, 0), (1, 1)], (50, 50), 1.0) == [(0, 0), (1, 1)]


def test_corridor_narrow_and_open():
    water = np.zeros((30, 60), bool)
    water[5:25, 2:20] = water[5:25, 40:58] = True
    water[14:16, 20:40] = True
    got = corridor.plan(water, (0, 3), (15, 55), 500.0, narrow_m=3000.0)
    assert got["path"][0][0] >= 5 and all(water[p] for p in got["path"])
    kinds = [k for _, _, k in got["runs"]]
    assert True in kinds and kinds.count(True) <= 3 and len(got["string"]) <= 6
    assert corridor.plan(water & (np.arange(60) != 30), (15, 5), (15, 55), 500.0) is None


def test_smoothing():
    lon, lat = [0.0, 0.5, 1.0, 1.5], [0.0, 0.2, -0.2, 0.0]
    leg = lambda a, b, c, d: geo.haversine(a, b, c, d) / 3.0
    seconds = [0.0, *(float(leg(lon[i], lat[i], lon[i + 1], lat[i + 1])) for i in range(3))]
    assert corridor.shortcut(lon, lat, seconds, leg) == [0, 3]
    total = lambda x, y: float(sum(leg(x[i], y[i], x[i + 1], y[i + 1]) for i in range(len(x) - 1)))
    x, y, best = corridor.polish(lon, lat, total, 30_000.0)
    assert best < sum(seconds) and x[0] == 0.0 and y[-1] == 0.0
    one = {"lon": [0, 1], "lat": [0, 1], "t": [0, 5], "sailing": [True, True], "seconds": 5, "metres": 7.0}
    both = corridor.stitch([one, one | {"lon": [1, 2]}])
    assert both["lon"] == [0, 1, 2] and both["seconds"] == 10 and both["junctions"] == [1, 2]


def test_leg_through_a_narrow_and_repairs():
    from tidewright.routing import isochrone, vessel

    water = np.zeros((60, 120), bool)
    water[10:50, 2:40] = water[10:50, 80:118] = True
    water[28:32, 40:80] = True
    polar = vessel.Boat(9.5, 3.2, 1.8, 5200, 62, 110).polar()
    wind = lambda lon, lat, t: (np.full(np.shape(lon), 7.0), np.full(np.shape(lon), 0.0))
    got = corridor.run_leg(water, (0.0, 50.0), 0.01, (0.1, 50.15), (1.1, 50.4), 0.0, polar, wind, isochrone.Policy(), narrow_m=6000.0, stages=8, bins=6)
    assert (np.diff(got["t"]) > 0).all() and True in got["sailing"] and False in got["sailing"] and got["lon"][-1] == 1.1
    assert corridor.run_leg(water & (np.arange(120) != 60), (0.0, 50.0), 0.01, (0.1, 50.15), (1.1, 50.4), 0.0, polar, wind, isochrone.Policy()) is None
    shallow = lambda a, b, c, d: min(a, c) < 0.5 < max(a, c) and abs(b + d) < 0.1
    line = {"lon": [0.0, 1.0], "lat": [0.0, 0.0], "metres": 1.0}
    fixed, left = corridor.repaired(line, shallow, lambda i, r: [(0.5, 0.3)] if i == 0 else None)
    assert fixed["lon"] == [0.0, 0.5, 1.0] and left == []
