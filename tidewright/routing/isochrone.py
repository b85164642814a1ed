"""Route search by stages: headings around the goal's bearing from every kept candidate, legs simulated in lockstep, the cheapest
of each cross-track bin kept. One request is one row; requests run side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tidewright.routing import geo
from tidewright.routing.vessel import Polar

Wind = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Land = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Policy:
    """motor: speed under engine; mode: motor, fastest or sail_max (sails from the threshold on)."""

    motor: float = 3.0
    mode: str = "fastest"
    threshold: float = 1.0
    tack_s: float = 30.0
    step_m: float = 200.0


def choose(sail: np.ndarray, policy: Policy) -> tuple[np.ndarray, np.ndarray]:
    sails = {"motor": np.zeros(len(sail), bool), "fastest": sail > policy.motor, "sail_max": sail >= policy.threshold}[policy.mode]
    return np.where(sails, sail, policy.motor), sails


def simulate(a_lon, a_lat, t, b_lon, b_lat, polar: Polar, wind: Wind, policy: Policy, land: Land | None = None, current: Wind | None = None, steps: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seconds, sailing (dominant) and stuck, of legs started at their own clocks t: a loop over sub-steps, all legs in each."""
    a_lon, a_lat, t, b_lon, b_lat = np.broadcast_arrays(*(np.asarray(x, float) for x in (a_lon, a_lat, t, b_lon, b_lat)))
    whole = geo.haversine(a_lon, a_lat, b_lon, b_lat)
    n = steps or max(1, int(np.ceil(whole.max(initial=0.0) / policy.step_m)))
    part, course = whole / n, geo.bearing(a_lon, a_lat, b_lon, b_lat)
    lon, lat, clock = a_lon.copy(), a_lat.copy(), t.copy()
    under, stuck = np.zeros(len(lon)), np.zeros(len(lon), bool)
    for _ in range(n):
        speed_w, from_w = wind(lon, lat, clock)
        speed, sails = choose(polar(from_w - course, speed_w), policy)
        if current is not None:
            c, to = current(lon, lat, clock)
            c = np.where(c > 10, 0.0, c)
            side = c * np.sin(np.radians(to - course))
            speed = np.sqrt(np.maximum(speed**2 - side**2, 0.0)) * (np.abs(side) < speed) + c * np.cos(np.radians(to - course))
        stuck |= ~(speed > 0)
        seconds = np.where(stuck, 0.0, part / np.where(speed > 0, speed, 1.0))
        under += np.where(sails, seconds, -seconds)
        clock = clock + seconds
        lon, lat = geo.destination(lon, lat, course, part)
        if land is not None:
            stuck |= land(lon, lat)
        course = np.where(geo.haversine(lon, lat, b_lon, b_lat) > 1.0, geo.bearing(lon, lat, b_lon, b_lat), course)
    return clock - t, under >= 0, stuck


def route(start: tuple[float, float], goal: tuple[float, float], depart: float, polar: Polar, wind: Wind, policy: Policy, land: Land | None = None, current: Wind | None = None, stages: int = 20, bins: int = 20, half_fan: float = 60.0, step_deg: float = 5.0, sub_steps: int = 4, shortlist: int = 64) -> dict | None:
    """The found route: lon, lat, t and sailing of its points, seconds and metres; None if the goal can't be reached."""
    distance = float(geo.haversine(*start, *goal))
    stage_m, width = distance / stages, distance / (2 * bins)
    fan = np.arange(-half_fan, half_fan + step_deg / 2, step_deg)
    lon, lat, t = np.array([start[0]]), np.array([start[1]]), np.array([depart])
    sails = np.array([True])
    kept = [(lon, lat, t, sails, np.array([-1]))]
    best: tuple[float, int, int, bool] | None = None
    nearest, stalled = distance, 0
    for stage in range(2 * stages):
        # from here straight to the goal, nearest first
        order = np.argsort(geo.haversine(lon, lat, *goal), kind="stable")[:shortlist]
        seconds, sailing, stuck = simulate(lon[order], lat[order], t[order], *goal, polar, wind, policy, land, current, steps=max(sub_steps, int(np.ceil(geo.haversine(lon[order], lat[order], *goal).max() / stage_m * sub_steps))))
        arrive = np.where(stuck, np.inf, t[order] + seconds)
        k = int(np.argmin(arrive))
        if np.isfinite(arrive[k]) and (best is None or arrive[k] < best[0]):
            best = (float(arrive[k]), stage, int(order[k]), bool(sailing[k]))
        left = geo.haversine(lon, lat, *goal).min()
        stalled = 0 if left < nearest - 0.05 * stage_m else stalled + 1
        nearest = min(nearest, left)
        if left <= stage_m or stalled > max(3, stages // 2):
            break
        for wider, finer, shorter in ((1, 1, 1.0), (2, 2, 1.0), (3, 2, 0.5)):  # wider sweeps where no child lives
            headings = np.clip(np.unique(np.concatenate([fan * wider])), -180, 180)
            parents = np.repeat(np.arange(len(lon)), len(headings))
            course = geo.bearing(lon[parents], lat[parents], *goal) + np.tile(headings, len(lon))
            to_lon, to_lat = geo.destination(lon[parents], lat[parents], course, stage_m * shorter)
            seconds, sailing, stuck = simulate(lon[parents], lat[parents], t[parents], to_lon, to_lat, polar, wind, policy, land, current, steps=sub_steps)
            before = sails[parents] & sailing & (stage > 0)
            seconds = seconds + np.where(before & _tacked(kept, parents, lon, lat, course, wind, t), policy.tack_s, 0.0)
            live = np.flatnonzero(~stuck)
            if len(live):
                break
        else:
            break
        offset = geo.cross_track(*start, *goal, to_lon[live], to_lat[live])
        slot = np.clip(np.floor(offset / width), -bins, bins)
        cost = t[parents[live]] + seconds[live] + geo.haversine(to_lon[live], to_lat[live], *goal) / max(policy.motor, 1.0)
        order = np.lexsort((live, cost, slot))
        first = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])]
        leader = np.argmin(geo.haversine(to_lon[live], to_lat[live], *goal))
        keep = np.unique(np.append(first, leader))
        i = live[keep]
        lon, lat, t, sails = to_lon[i], to_lat[i], t[parents[i]] + seconds[i], sailing[i]
        kept.append((lon, lat, t, sails, parents[i]))
    if best is None:
        return None
    arrive, stage, at, sailing = best
    points = [(*goal, arrive, sailing)]
    while stage >= 0:
        k = kept[stage]
        points.append((k[0][at], k[1][at], k[2][at], bool(k[3][at])))
        stage, at = stage - 1, int(k[4][at])
    points.reverse()
    line = np.array([p[:3] for p in points], float)
    return {"lon": line[:, 0].tolist(), "lat": line[:, 1].tolist(), "t": line[:, 2].tolist(), "sailing": [p[3] for p in points], "seconds": arrive - depart, "metres": float(geo.haversine(line[:-1, 0], line[:-1, 1], line[1:, 0], line[1:, 1]).sum())}


def multi(stops: list[tuple[float, float]], depart: float, polar: Polar, wind: Wind, policy: Policy, **search) -> dict | None:
    """Routes from stop to stop, each from when the one before arrives, end to end."""
    from tidewright.routing.corridor import stitch

    legs = []
    for a, b in zip(stops, stops[1:], strict=False):
        found = route(a, b, legs[-1]["t"][-1] if legs else depart, polar, wind, policy, **search)
        if found is None:
            return None
        legs.append(found)
    return stitch(legs)


def _tacked(kept, parents, lon, lat, course, wind, t):
    """Whether a new leg has the wind on the other side than the leg that led to its parent."""
    if len(kept) < 2:
        return np.zeros(len(parents), bool)
    before = kept[-2]
    own = kept[-1][4]
    came = geo.bearing(before[0][own], before[1][own], lon, lat)[parents]
    _, from_w = wind(lon[parents], lat[parents], t[parents])
    side = lambda c: (from_w - c + 180) % 360 - 180
    return side(came) * side(course) < 0


def simplify(lon, lat, tolerance_m: float, keep=(), crosses: Callable | None = None) -> list[int]:
    """Indices that Ramer-Douglas-Peucker keeps: ends, `keep`, and all where a shortcut would cross land."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    out, todo = {0, len(lon) - 1, *keep}, []
    fixed = sorted(out)
    todo = list(zip(fixed, fixed[1:], strict=False))
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = np.abs(geo.cross_track(lon[a], lat[a], lon[b], lat[b], lon[a + 1 : b], lat[a + 1 : b]))
        k = a + 1 + int(np.argmax(d))
        if d.max() > tolerance_m or (crosses is not None and crosses(lon[a], lat[a], lon[b], lat[b])):
            out.add(k)
            todo += [(a, k), (k, b)]
    return sorted(out)


def string_pull(n: int, visible: Callable[[int, int], bool]) -> list[int]:
    """From each kept node to the farthest visible one."""
    out, at = [0], 0
    while at < n - 1:
        at = next((j for j in range(n - 1, at + 1, -1) if visible(at, j)), at + 1)
        out.append(at)
    return out
