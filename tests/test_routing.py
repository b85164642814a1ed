import numpy as np
import pytest

from tidewright.routing import frames, geo, isochrone, raster, vessel

POLAR = vessel.Boat(9.5, 3.2, 1.8, 5200, 62, 110).polar()
ROWS = [(a, w, POLAR.speed[i, j]) for i, a in enumerate(POLAR.twa) for j, w in enumerate(POLAR.tws)]


def steady(speed, direction):
    return lambda lon, lat, t: (np.full(np.shape(lon), speed), np.full(np.shape(lon), direction))


def test_motor_leg_takes_distance_over_speed():
    policy = isochrone.Policy(motor=4.0, mode="motor")
    seconds, sailing, stuck = isochrone.simulate([0.0], [50.0], [0.0], [1.0], [50.5], POLAR, steady(8, 0), policy)
    assert abs(seconds[0] - geo.haversine(0, 50, 1, 50.5) / 4.0) < 1 and not sailing[0] and not stuck[0]
    against, _, _ = isochrone.simulate([0.0], [0.0], [0.0], [0.0], [1.0], POLAR, steady(8, 0), policy, current=steady(1.0, 180.0), steps=10)
    assert abs(against[0] - geo.haversine(0, 0, 0, 1) / 3.0) < 1


def test_boat_speeds_are_plausible():
    s = vessel.Boat(9.5, 3.2, 1.8, 5200, 62, 110)
    v = s.speed([60, 90, 120], [7, 7, 7])
    assert (v > 1.5).all() and (v < 2 * s.hull_speed).all() and s.speed(10, 8) == 0
    assert (np.diff(s.speed(np.full(5, 100.0), [2, 4, 6, 8, 10])) > 0).all()


def test_hull_holds_every_sample():
    h = vessel.Hull(POLAR, 7.0)
    for a in range(0, 181, 5):
        assert h.speed(a)[0] >= POLAR(a, 7.0) - 1e-6
    up, (a, b, share) = h.speed(0)
    assert up > 0 and abs(a + b) < 1e-6 and abs(share - 0.5) < 1e-6


def test_route_around_an_island_and_to_windward():
    land = lambda lon, lat: (np.abs(lon - 0.5) < 0.1) & (np.abs(lat - 50.0) < 0.1)
    found = isochrone.route((0.0, 50.0), (1.0, 50.0), 0.0, POLAR, steady(7, 0), isochrone.Policy(motor=1.0), land=land)
    straight = geo.haversine(0, 50, 1, 50)
    assert found["metres"] > 1.01 * straight and found["lon"][-1] == 1.0 and not land(np.array(found["lon"]), np.array(found["lat"])).any()
    assert (np.diff(found["t"]) > 0).all() and abs(found["t"][-1] - found["seconds"]) < 1e-6
    beat = isochrone.route((0.0, 50.0), (0.0, 50.6), 0.0, POLAR, steady(7, 0), isochrone.Policy(motor=0.3))
    assert beat["metres"] > 1.1 * geo.haversine(0, 50, 0, 50.6)
    walled = isochrone.route((0.0, 50.0), (1.0, 50.0), 0.0, POLAR, steady(7, 0), isochrone.Policy(), land=lambda lon, lat: np.ones(np.shape(lon), bool))
    assert walled is None


def test_stops_in_turn():
    found = isochrone.multi([(0.0, 50.0), (0.3, 50.2), (0.6, 50.0)], 100.0, POLAR, steady(7, 300), isochrone.Policy(), stages=6, bins=5)
    assert (np.diff(found["t"]) > 0).all() and found["t"][0] == 100.0 and (0.3, 50.2) in set(zip(found["lon"], found["lat"], strict=True))


def test_requests_run_side_by_side(spark):
    rows = [(i, 0.0, 50.0, 0.5, 50.1, float(i), 5.0 + i, 300.0) for i in range(4)]
    df = spark.createDataFrame(rows, "route long, lon0 double, lat0 double, lon1 double, lat1 double, depart double, wind_ms double, wind_from double").repartition(4)
    got = frames.route_requests(df, ROWS, stages=8, bins=6).cache()
    assert got.select("route").distinct().count() == 4
    slow, fast = (got.where(f"route = {i}").first().seconds for i in (0, 3))
    assert fast < slow
    hulls = frames.corridor(got.selectExpr("1L as g", "route", "seq", "lon", "lat"), "g", 10)
    assert hulls.where("slice = 9").count() >= 1
    assert frames.simplified(got, 50_000.0).count() == 8


def test_distances_by_brute_force(spark):
    rng = np.random.default_rng(0)
    blocked = rng.random((23, 31)) < 0.05
    r, c = np.nonzero(blocked)
    i, j = np.indices(blocked.shape)
    want = np.sqrt(((i[..., None] - r) ** 2 + (j[..., None] - c) ** 2).min(-1))
    assert np.allclose(raster.distance_cells(blocked), want) and np.isinf(raster.distance_cells(np.zeros((2, 2), bool))).all()
    cells = spark.createDataFrame([(int(a), int(b), bool(blocked[a, b])) for a in range(23) for b in range(31)], "row int, col int, blocked boolean")
    got = {(x.row, x.col): x.dist for x in frames.tile_distance(cells, 8, 6).collect()}
    assert all(abs(got[a, b] - min(want[a, b], 6)) < 1e-9 for a in range(23) for b in range(31))


def test_astar():
    water = np.ones((20, 20), bool)
    water[5, :15] = water[12, 5:] = False
    path = raster.astar(water, (0, 0), (19, 19))
    assert path[0] == (0, 0) and path[-1] == (19, 19) and all(water[p] for p in path)
    assert (5, 15) in path or any(p[0] == 5 and p[1] >= 15 for p in path)
    assert raster.astar(~water, (0, 0), (19, 19)) is None
    open_ = np.ones((9, 30), bool)
    length = lambda p: sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:], strict=False))
    assert abs(length(raster.astar(open_, (0, 0), (4, 8))) - 4 * np.sqrt(5)) < 1e-9
    around = raster.astar(open_, (4, 1), (4, 28), wrap=True)
    assert len(around) <= 4


def test_cells_of_segments_and_polygons():
    assert raster.supercover(0.5, 0.5, 3.5, 0.5) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert set(raster.supercover(0.5, 0.5, 2.5, 2.5)) == {(0, 0), (1, 0), (0, 1), (1, 1), (2, 1), (1, 2), (2, 2)}
    ring = np.array([[1.2, 1.2], [6.7, 1.4], [6.1, 5.5], [2.0, 6.3]])
    filled = raster.fill_polygons([ring], 8, 9)
    rng = np.random.default_rng(0)
    for x, y in rng.random((300, 2)) * [9, 8]:
        inside = sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, np.roll(ring, -1, 0), strict=True)) % 2
        assert not inside or filled[int(y), int(x)]
    cut = raster.clip_ring(np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]), 0, 2.5, True)
    assert cut[:, 0].max() == 2.5 and len(cut) == 4


def test_two_basins_have_one_neck():
    clear = np.zeros((9, 21))
    for r in range(9):
        for c in range(21):
            clear[r, c] = max(0.0, 5 - np.hypot(r - 4, c - 5), 5 - np.hypot(r - 4, c - 15), 0.8 - abs(r - 4))
    assert [(r, c) for r, c, _ in raster.chokepoints(clear)] == [(4, 10)] or [p[0] for p in raster.chokepoints(clear)] == [4]


@pytest.mark.parametrize("noise", [0, 1])
def test_simplify_and_pull(noise):
    lon, lat = np.linspace(0, 1, 21), np.zeros(21)
    lat[10] = 0.2 * noise
    kept = isochrone.simplify(lon, lat, 100.0)
    assert kept == ([0, 20] if not noise else [0, 9, 10, 11, 20])
    assert isochrone.string_pull(6, lambda i, j: j - i <= 2) == [0, 2, 4, 5]
    runs = raster.segments(np.array([500] * 5 + [2000] * 2 + [500] * 3 + [2000] * 8), np.arange(18) * 500.0, 1000.0)
    assert runs == [(0, 9, True), (10, 17, False)]
