"""Parts of coarse cells, canals and buffers against floods by hand."""

import random

import numpy as np
import pytest

from tests.test_mesh import grid
from tidewright.operators import graphs, shores, waters
from tidewright.routing import mesh


def flood(water, around=None):
    label = {}
    for start in sorted(water):
        todo = [start]
        while todo:
            r, c = todo.pop()
            if (r, c) in label or (r, c) not in water:
                continue
            label[r, c] = start
            todo += [(r + 1, c), (r - 1, c), (r, (c + 1) % around if around else c + 1), (r, (c - 1) % around if around else c - 1)]
    return label


@pytest.mark.parametrize(("k", "around"), [(4, None), (4, 24), (5, None)])
def test_parts_make_the_same_waters(spark, k, around):
    rng = random.Random(k)
    water = {(r, c) for r in range(20) for c in range(24) if rng.random() < 0.6}
    parts = waters.split_cells(spark.createDataFrame(sorted(water), "row int, col int"), k).cache()
    nodes = parts.select(parts.node.alias("id")).distinct()
    label = graphs.connected(nodes, waters.part_links(parts, k, around=around))
    got = {}
    for r in parts.join(label, parts.node == label.id).collect():
        got.setdefault(r.component, set()).add((r.row, r.col))
    want = {}
    for at, first in flood(water, around).items():
        want.setdefault(first, set()).add(at)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    for b in {(r // k, c // k) for r, c in water}:  # inside a block, parts are what its own cells link
        own = flood({(r, c) for r, c in water if (r // k, c // k) == b})
        numbers = {first: i + 1 for i, first in enumerate(sorted(set(own.values())))}
        for r in parts.where((parts.brow == b[0]) & (parts.bcol == b[1])).collect():
            assert r.part == numbers[own[r.row, r.col]]


def test_canals_close_sides(spark):
    water = [(r, c) for r in range(8) for c in range(8)]
    parts = waters.split_cells(spark.createDataFrame(water, "row int, col int"), 2).cache()
    assert parts.select("node").distinct().count() == 16
    lines = "x0 double, y0 double, x1 double, y1 double"
    sides = lambda *line: {tuple(r) for r in shores.sides_cut(spark.createDataFrame([line], lines), 0.0, 0.0, 1.0, 4, 4).collect()}
    assert sides(0.5, 0.5, 2.5, 0.5) == {(0, 0, "east"), (0, 1, "east")}
    assert sides(0.5, 0.5, 0.5, 0.9) == set()
    assert sides(0.5, 0.5, 1.5, 1.5) == {(0, 0, "east"), (0, 0, "north"), (1, 0, "east"), (0, 1, "north")}
    wall = spark.createDataFrame([(-1.0, 1.5, 5.0, 1.25), (1.5, -1.0, 1.5, 5.0)], lines)
    cuts = shores.sides_cut(wall, 0.0, 0.0, 1.0, 4, 4)
    label = graphs.connected(parts.select(parts.node.alias("id")).distinct(), waters.part_links(parts, 2, cuts))
    # the first line crosses the east sides of row 1, the second the north sides of column 1
    links = {(r.a // waters.PARTS, r.b // waters.PARTS) for r in waters.part_links(parts, 2, cuts).collect()}
    number = lambda r, c: r * 1048576 + c
    want = {(number(r, c), number(r, c + 1)) for r in range(4) for c in range(3) if r != 1} | {(number(r, c), number(r + 1, c)) for r in range(3) for c in range(4) if c != 1}
    assert links == want and label.count() == 16


def test_blocks_of_too_many_parts(spark):
    with pytest.raises(ValueError, match="parts"):
        waters.split_cells(spark.createDataFrame([(0, 0)], "row int, col int"), 64)


def test_buffer_is_the_walk_of_each_edge(spark):
    rng = random.Random(3)
    corners, near, _ = grid(7)
    m = mesh.Mesh(corners, near)
    for buffer, share in ((0.3, 0.1), (1.1, 0.06)):
        blocked = np.array([rng.random() < share for _ in range(len(corners))])
        rows = [(i, corners[i].ravel().tolist(), [int(x) for x in near[i]], bool(blocked[i])) for i in range(len(corners))]
        tri = spark.createDataFrame(rows, "id long, corners array<double>, neighbours array<int>, blocked boolean")
        got = {r.id: r.apart for r in waters.near_blocked(tri, buffer).collect()}
        assert set(got) == set(np.flatnonzero(m.grown(blocked, buffer)).tolist())
        assert all(got[i] == 0 for i in np.flatnonzero(blocked)) and all(d <= buffer for d in got.values())


def test_nothing_blocked(spark):
    tri = spark.createDataFrame([(0, [0.0, 0.0, 1.0, 0.0, 0.0, 1.0], [-1, -1, -1], False)], "id long, corners array<double>, neighbours array<int>, blocked boolean")
    assert waters.near_blocked(tri, 5.0).count() == 0
