"""Paths, changes of chart and forests against searches by hand."""

import heapq
import math
import random

import pytest

from tidewright.operators import paths


def dijkstra(adj, starts):
    best, heap = {}, [(c, i) for i, c in starts.items()]
    heapq.heapify(heap)
    while heap:
        c, i = heapq.heappop(heap)
        if i in best:
            continue
        best[i] = c
        for j, w in adj.get(i, []):
            if j not in best:
                heapq.heappush(heap, (c + w, j))
    return best


@pytest.mark.parametrize("whole", [True, False])
def test_cheapest_paths(spark, whole):
    rng = random.Random(3)
    edges = [(rng.randint(0, 25), rng.randint(0, 25), rng.randint(1, 4) if whole else rng.choice([0.7, 0.5, 0.25 + 1e-9])) for _ in range(90)]
    sources = [(s, rng.randint(0, 25), rng.randint(0, 2) if whole else rng.random()) for s in range(5) for _ in range(2)]
    kind = "long" if whole else "double"
    given = edges + [(None, 1, edges[0][2]), (3, 3, edges[0][2]), (4, 5, None)]
    got = paths.cheapest_paths(spark.createDataFrame(sources, f"search long, id long, cost {kind}"), spark.createDataFrame(given, f"a long, b long, cost {kind}"))
    labels = {(r.search, r.id): (r.cost, r.parent) for r in got.collect()}
    adj = {}
    for a, b, w in edges:
        if a != b:
            adj.setdefault(a, []).append((b, w))
    want = {}
    for s in range(5):
        own = {}
        for t, i, c in sources:
            if t == s:
                own[i] = min(c, own.get(i, math.inf))
        best = dijkstra(adj, own)
        for i, c in best.items():
            parents = [a for a, out in adj.items() for b, w in out if b == i and a in best and best[a] + w == c]
            want[s, i] = (c, None if own.get(i) == c else min(parents))
    assert labels == want


def test_paths_to_goals(spark):
    rng = random.Random(8)
    edges = [(a, b, rng.randint(3, 6)) for a in range(80) for b in rng.sample(range(80), 3) if a != b]
    df = spark.createDataFrame(edges, "a long, b long, cost long")
    sources = spark.createDataFrame([(1, 0, 0), (2, 7, 0)], "search long, id long, cost long")
    goals = spark.createDataFrame([(1, 40), (1, 41), (2, 0), (2, 999)], "search long, id long")
    labels = paths.cheapest_paths(sources, df, goals)
    found = {}
    for r in paths.traced(labels, goals).orderBy("search", "goal", "seq").collect():
        found.setdefault((r.search, r.goal), []).append((r.seq, r.id, r.cost))
    adj = {}
    cost = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        cost[a, b] = min(w, cost.get((a, b), w))
    reached = {1: dijkstra(adj, {0: 0}), 2: dijkstra(adj, {7: 0})}
    assert set(found) == {(s, g) for s, g in ((1, 40), (1, 41), (2, 0), (2, 999)) if g in reached[s]} and len(found) > 1
    for (search, goal), way in found.items():
        start = {1: 0, 2: 7}[search]
        assert way[0] == (0, start, 0) and way[-1][1] == goal and [s for s, _, _ in way] == list(range(len(way)))
        assert all(way[i + 1][2] == way[i][2] + cost[way[i][1], way[i + 1][1]] for i in range(len(way) - 1))
        assert way[-1][2] == dijkstra(adj, {start: 0})[goal]


def test_costs_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        paths.cheapest_paths(spark.createDataFrame([(1, 1, 0)], "search long, id long, cost long"), spark.createDataFrame([(1, 2, 0)], "a long, b long, cost long"))


def test_no_sources_no_edges(spark):
    none = spark.createDataFrame([], "search long, id long, cost long")
    edges = spark.createDataFrame([], "a long, b long, cost long")
    assert paths.cheapest_paths(none, edges).count() == 0
    one = spark.createDataFrame([(1, 5, 2)], "search long, id long, cost long")
    assert [tuple(r) for r in paths.cheapest_paths(one, edges).collect()] == [(1, 5, 2, None)]


def grid_moves(water, south, res, unit, around):
    def is_water(r, c):
        return (r, c % around if around else c) in water

    out = {}
    for r, c in water:
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                if not (dr or dc) or not is_water(r + dr, c + dc) or (dr and dc and not (is_water(r + dr, c) and is_water(r, c + dc))):
                    continue
                coast = next((k for k in range(1, 5) if any(not is_water(r + dr + i, c + dc + j) for i in range(-k, k + 1) for j in range(-k, k + 1))), 5)
                cos = math.cos(math.radians(south + (r + 0.5 + dr / 2) * res))
                metres = math.hypot(dr, dc * cos) * res * paths.DEGREE_M
                to = (c + dc) % around if around else c + dc
                out[r * 1048576 + c, (r + dr) * 1048576 + to] = metres * (1 if coast > 4 else 1 + 0.4 * (5 - coast) / 4) / unit
    return out


@pytest.mark.parametrize("around", [None, 12])
def test_moves_over_water(spark, around):
    rng = random.Random(1)
    water = {(r, c) for r in range(14) for c in range(12) if rng.random() < 0.93}
    got = {(x.a, x.b): x.cost for x in paths.water_moves(spark.createDataFrame(sorted(water), "row int, col int"), 40.0, 0.5, around=around).collect()}
    want = grid_moves(water, 40.0, 0.5, 0.1, around)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) <= 0.5 + 1e-6 for k in want)


def test_fewest_changes_of_chart(spark):
    rng = random.Random(11)
    for trial in range(1):
        places, charts = range(12), "abc"
        usable = {(p, c) for p in places for c in charts if rng.random() < 0.7}
        edges = [(rng.choice(places), rng.choice(places), rng.choice(charts), rng.randint(2, 4)) for _ in range(40)]
        sources = [(1, 0), (2, 3)]
        found, labels = paths.fewest_changes(spark.createDataFrame(sources, "search long, place long"), spark.createDataFrame(edges, "a long, b long, chart string, cost long"), spark.createDataFrame(sorted(usable), "place long, chart string"))
        want = {}
        for search, start in sources:
            heap = [((0, 0), start, c) for c in charts if (start, c) in usable]
            done = {}
            while heap:
                cost, p, c = heapq.heappop(heap)
                if (p, c) in done:
                    continue
                done[p, c] = cost
                heap += [((cost[0] + 1, cost[1]), p, d) for d in charts if d != c and (p, d) in usable]
                heap += [((cost[0], cost[1] + w), b, c) for a, b, d, w in edges if a == p and d == c and a != b and (a, c) in usable and (b, c) in usable]
                heapq.heapify(heap)
            for (p, _), cost in done.items():
                want[search, p] = min(cost, want.get((search, p), cost))
            want[search, start] = (0, 0)
        assert {(r.search, r.place): (r.changes, r.cost) for r in found.collect()} == want
        if trial == 0:  # a way keeps to one chart between places
            goals = labels.where("size(id.charts) = 0").select("search", "id")
            ways = {}
            for r in paths.traced(labels, goals).orderBy("seq").collect():
                ways.setdefault((r.search, r.goal.place), []).append((r.id.place, tuple(r.id.charts)))
            legs = {(a, b, c) for a, b, c, _ in edges}
            for way in ways.values():
                for (p, c), (q, d) in zip(way, way[1:], strict=False):
                    assert (p == q and (not c) != (not d)) or (c == d and (p, q, c[0]) in legs)


def kruskal(values, edges):
    """(width, lesser peak) of each merge by the elder rule."""
    up = {i: i for i in values}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    out = []
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        x, y = root(a), root(b)
        if x == y:
            continue
        low, high = sorted((x, y), key=lambda i: (values[i], -i))
        out.append((w, values[low], low))
        up[low] = high
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_forest_by_union_find(spark, ties):
    rng = random.Random(4)
    values = {i: rng.randint(0, 6) if ties else rng.randint(0, 10**9) for i in range(40)}
    pairs = [(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(80)) if a != b]
    edges = [(a, b, rng.randint(0, 4) if ties else rng.randint(0, 10**9)) for a, b in pairs]
    got = paths.highest_forest(spark.createDataFrame(list(values.items()), "id long, value long"), spark.createDataFrame(edges, "a long, b long, w long")).collect()
    want = kruskal(values, edges)
    assert sorted((r.w, r.low.value) for r in got) == sorted((w, v) for w, v, _ in want)
    if not ties:
        assert sorted((r.w, r.low.id) for r in got) == sorted((w, i) for w, _, i in want)
    assert len(got) == len(kruskal(values, [(r.a, r.b, r.w) for r in got]))  # no circle


def test_chokepoints(spark):
    rng = random.Random(12)
    clear = {(r, c): rng.choice([0, 0, rng.randint(1, 100_000)]) for r in range(11) for c in range(11)}
    water = {k: v for k, v in clear.items() if v}
    number = lambda r, c: r * 1048576 + c
    edges = [(number(r, c), number(r + i, c + j)) for r, c in water for i, j in ((0, 1), (1, 0)) if (r + i, c + j) in water]
    cells = spark.createDataFrame([(number(*k), v) for k, v in water.items()], "id long, clear long")
    got = {(r.cell, r.clear, r.basin, r.basin_clear) for r in paths.chokepoints(cells, spark.createDataFrame(edges, "a long, b long"), 60_000, 1.3, 500, 20_000).collect()}
    of = {number(*k): v for k, v in water.items()}
    want = {(next(i for i, v in of.items() if v == w), w, low, v) for w, v, low in kruskal(of, [(a, b, min(of[a], of[b])) for a, b in edges]) if w <= 60_000 and v >= 1.3 * w and v >= w + 500 and v >= 20_000}
    assert got == want and got


def test_no_water_no_chokepoints(spark):
    cells = spark.createDataFrame([], "id long, clear double")
    assert paths.chokepoints(cells, spark.createDataFrame([], "a long, b long"), 1.0, 1.0, 0.0, 0.0).count() == 0


def test_a_chart_takes_one_round_whatever_its_ways_steps(spark):
    n = 60
    edges = [(k, k + 1, "a", 1 + k % 2) for k in range(n)] + [(n, n + 1, "b", 5)]
    usable = [(k, "a") for k in range(n + 1)] + [(n, "b"), (n + 1, "b")]
    context = spark.sparkContext
    context.setJobGroup("charts", "charts")
    found, _ = paths.fewest_changes(spark.createDataFrame([(1, 0)], "search long, place long"), spark.createDataFrame(edges, "a long, b long, chart string, cost long"), spark.createDataFrame(usable, "place long, chart string"))
    jobs = len(context.statusTracker().getJobIdsForGroup("charts"))
    context.setJobGroup("others", "others")
    at = [sum(1 + i % 2 for i in range(k)) for k in range(n + 1)]
    assert {r.place: (r.changes, r.cost) for r in found.collect()} == {k: (0, c) for k, c in enumerate(at)} | {n + 1: (1, at[n] + 5)}
    assert jobs < 2 * n


@pytest.mark.parametrize("to_goals", [False, True])
def test_charts_in_several_groups(spark, monkeypatch, to_goals):
    monkeypatch.setattr(paths, "EDGES", 40)
    monkeypatch.setattr(paths, "SEARCHES", 1)
    rng = random.Random(5)
    places, charts = range(30), "abc"
    usable = {(p, c) for p in places for c in charts if rng.random() < 0.6}
    edges = [(rng.choice(places), rng.choice(places), "a" if rng.random() < 0.6 else rng.choice(charts), rng.randint(1, 9)) for _ in range(150)]
    sources = [(1, 0), (2, 3), (2, 4), (7, 9), (8, 99)]
    goals = spark.createDataFrame([(1, 5), (2, 6), (7, 7)], "search long, place long") if to_goals else None
    found, labels = paths.fewest_changes(spark.createDataFrame(sources, "search long, place long"), spark.createDataFrame(edges, "a long, b long, chart string, cost long"), spark.createDataFrame(sorted(usable), "place long, chart string"), goals)
    want = {}
    for search in (1, 2, 7, 8):
        heap = [((0, 0), p, c) for s, p in sources if s == search for c in charts if (p, c) in usable]
        done = {}
        while heap:
            cost, p, c = heapq.heappop(heap)
            if (p, c) in done:
                continue
            done[p, c] = cost
            for d in charts:
                if d != c and (p, d) in usable:
                    heapq.heappush(heap, ((cost[0] + 1, cost[1]), p, d))
            for a, b, d, w in edges:
                if a == p and d == c and a != b and (a, c) in usable and (b, c) in usable:
                    heapq.heappush(heap, ((cost[0], cost[1] + w), b, c))
        for (p, _), cost in done.items():
            want[search, p] = min(cost, want.get((search, p), cost))
        want |= {(s, p): (0, 0) for s, p in sources if s == search}
    got = {(r.search, r.place): (r.changes, r.cost) for r in found.collect()}
    assert got.items() <= want.items() and max(want.values())[0] > 0
    assert set(got) >= ({k for k in want if k in {(1, 5), (2, 6), (7, 7)}} if to_goals else set(want))
    heads = {(r.search, r.id.place) for r in labels.where("size(id.charts) = 0 and parent is null").collect()}
    assert heads == set(sources)
