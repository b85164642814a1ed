"""Every query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tidewright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return repr(round(float(v), 5) + 0.0)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(same(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cursor.fetchall(), names)


def test_tide_turns_by_brute_force(spark, duck):
    from tidewright.plans.base import HOURLY

    s = dict(duck.execute(f"WITH {HOURLY} SELECT h, v FROM hourly").fetchall())
    turns, start = [], None
    for h in sorted(s):  # runs of equal values between two that are both lower or both higher
        if s.get(h - 1) == s[h]:
            continue
        end = h
        while s.get(end + 1) == s[h]:
            end += 1
        p, n = s.get(h - 1), s.get(end + 1)
        if p is not None and n is not None and (p < s[h] > n or p > s[h] < n):
            turns.append(((h + end) / 2, s[h], "high" if p < s[h] else "low"))
    while len(turns) > 1:
        gap, at = min((abs(a[1] - b[1]), i) for i, (a, b) in enumerate(zip(turns, turns[1:], strict=False)))
        if gap >= 5.0:
            break
        del turns[at : at + 2]
        if 0 < at < len(turns) and turns[at - 1][2] == turns[at][2]:
            pick = max if turns[at][2] == "high" else min
            turns[at - 1 : at + 1] = [pick(turns[at - 1 : at + 1], key=lambda x: x[1])]
    got = sorted(tuple(r) for r in registry.QUERIES["tide_turns"](spark, SF).select("h", "v", "kind").collect())
    assert got == turns and len(got) > 10


def test_contour_lines_are_their_segments(spark):
    from tidewright.operators import grids
    from tidewright.plans.base import price_grid

    lines = registry.QUERIES["contour_lines"](spark, SF).collect()
    near = lambda x, y: (round(x, 9), round(y, 9))
    for level in (50_000.0, 52_000.0):
        want = sorted(tuple(sorted((near(r.x0, r.y0), near(r.x1, r.y1)))) for r in grids.contour_segments(price_grid(spark, SF), "v", level).collect())
        own = [list(zip(r.xs, r.ys, strict=True)) for r in lines if r.level == level]
        assert sorted(tuple(sorted(x)) for line in own for x in zip(line, line[1:], strict=False)) == want
        ends = [p for line in own if line[0] != line[-1] for p in (line[0], line[-1])]
        meets = lambda p: sum(p in x for x in want)
        assert all(meets(p) % 2 == 1 or meets(p) > 2 or ends.count(p) > 1 for p in ends)  # an open line ends where no other goes on


def test_leg_cells_by_samples(spark, duck):
    from tidewright.plans.base import OBS

    cells = {}
    for r in registry.QUERIES["leg_cells"](spark, SF).collect():
        cells.setdefault(r.event_id, set()).add((r.col, r.row))
    for e, x0, y0, x1, y1 in duck.execute(f"WITH {OBS} SELECT event_id, lon, lat, lon + event_id % 7 - 3, lat + user_id % 5 - 2 FROM obs").fetchall():
        inner = [(x0 + (x1 - x0) * t / 1009, y0 + (y1 - y0) * t / 1009) for t in range(1, 1009)]
        assert {(math.floor(x), math.floor(y)) for x, y in inner} <= cells[e]
        for i, j in cells[e]:  # each cell is touched: the leg's part over its columns meets its rows
            low, high = (max(0.0, (i - x0) / (x1 - x0)), min(1.0, (i + 1 - x0) / (x1 - x0))) if x1 > x0 else (max(0.0, (i + 1 - x0) / (x1 - x0)), min(1.0, (i - x0) / (x1 - x0))) if x1 < x0 else (0.0, 1.0)
            ys = sorted(y0 + (y1 - y0) * t for t in (low, high))
            assert i - 1e-9 <= max(x0, x1) and min(x0, x1) <= i + 1 + 1e-9 and low <= high + 1e-9 and ys[0] <= j + 1 + 1e-9 and ys[1] >= j - 1e-9


def test_departures_are_sailed(spark):
    from tidewright.functions.geodesy import RADIUS

    def metres(a, b):
        p, q = math.radians(a.lat), math.radians(b.lat)
        return 2 * RADIUS * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2))

    routes = {}
    for r in registry.QUERIES["departure_window"](spark, SF).collect():
        routes.setdefault(r.route, []).append(r)
    departures = {r.n_nationkey: r.n_nationkey * 21600.0 for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    assert set(routes) == set(departures)
    for k, rows in routes.items():
        rows.sort(key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(len(rows))) and rows[0].t == departures[k]
        assert (rows[0].lon, rows[0].lat, round(rows[-1].lon, 6), round(rows[-1].lat, 6)) == (-5.0, 48.0, -4.0, 49.2)
        steps = [metres(a, b) for a, b in zip(rows, rows[1:], strict=False)]
        assert all(0 < d / (b.t - a.t) < 12 for d, a, b in zip(steps, rows, rows[1:], strict=False))
        assert abs(rows[-1].t - rows[0].t - rows[0].seconds) < 1 and abs(sum(steps) - rows[0].metres) < 0.01 * rows[0].metres + 1
        assert rows[0].metres >= metres(rows[0], rows[-1]) - 1


def test_every_query_has_sql_or_a_test():
    here = {"tide_turns", "contour_lines", "leg_cells", "departure_window"}
    elsewhere = {"chokepoints", "buffered_triangles", "refresh_queue", "map_bursts"}  # their operators: test_paths, test_waters, test_stateful
    assert set(registry.QUERIES) - set(registry.ORACLES) == here | elsewhere


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
