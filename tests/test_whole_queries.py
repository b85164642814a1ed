"""Queries that leave no key of their tables out; the ones with SQL are in test_queries.py too."""

import os

import duckdb
import pytest

from tidewright.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def sql(text):
    return duckdb.sql(text).fetchall()


@pytest.mark.parametrize(
    "name, key, want",
    [
        ("tidal_arguments", "event_id", "SELECT event_id FROM '{}/events.parquet'"),
        ("series_sample", "event_id", "SELECT event_id FROM '{}/events.parquet'"),
        ("wind_components", "event_id", "SELECT event_id FROM '{}/events.parquet'"),
        ("backtrace_path", "path", "SELECT max(o_orderkey) FROM '{}/orders.parquet' GROUP BY o_custkey"),
        ("step_ladder", "cycle", "SELECT DISTINCT date_trunc('day', o_orderdate) + INTERVAL 6 HOUR * (o_orderkey % 4) FROM '{}/orders.parquet'"),
    ],
)
def test_no_key_is_left_out(spark, name, key, want):
    assert {r[0] for r in registry.QUERIES[name](spark, SF).select(key).distinct().collect()} == {r[0] for r in sql(want.format(SF))}


def test_steps_of_all_orders(spark):
    days = {r[0] for r in sql(f"SELECT floor(epoch(o_orderdate) / 86400)::BIGINT FROM '{SF}/orders.parquet'")}
    got = registry.QUERIES["asof_unkeyed"](spark, SF).collect()
    assert {r.tm for r in got if r.tm in days} == {r.tm for r in got if r.t0 == r.t1 == r.tm} != set()


def test_winds_of_all_directions(spark):
    got = {r.event_id: r for r in registry.QUERIES["wind_components"](spark, SF).collect()}
    apart = lambda a, b: abs((a - b + 180) % 360 - 180)
    cardinal = 0
    for e, value in sql(f"SELECT event_id, value FROM '{SF}/events.parquet'"):
        a = e * 29 % 360  # u and v are wind * cos and wind * sin of it
        cardinal += a % 90 == 0
        if value > 0:
            assert apart(got[e].from_deg, 270 - a) < 1e-4 and apart(got[e].to_deg, 90 - a) < 1e-4
    assert cardinal


def test_hops_over_all_links(spark):
    near = {}
    for a, b in sql(f"SELECT DISTINCT o_custkey % 60, (o_orderkey // 4) % 60 FROM '{SF}/orders.parquet'"):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, frontier, d = {0: 0}, {0}, 0
    while frontier:
        d += 1
        frontier = {b for a in frontier for b in near.get(a, ())} - set(want)
        want |= dict.fromkeys(frontier, d)
    assert {r.id: r.dist for r in registry.QUERIES["bfs_hops"](spark, SF).collect()} == want


def test_components_of_the_whole_grid(spark):
    from tidewright.plans.base import GRID

    land = {(r, c) for r, c, v in sql(f"WITH {GRID.replace('FROM lineitem', f"FROM '{SF}/lineitem.parquet'")} SELECT * FROM grid") if int(v) % 5 <= 1}
    want = {}
    for cell in sorted(land):  # the first cell met of a component has its least id
        fill = [cell] if cell not in want else []
        while fill:
            r, c = at = fill.pop()
            if at in land and at not in want:
                want[at] = cell[0] * 1048576 + cell[1]
                fill += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    got = {(r.row, r.col): r.component for r in registry.QUERIES["grid_components"](spark, SF).collect()}
    assert got == want and max(got)[0] >= 16
