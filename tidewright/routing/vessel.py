"""Boats for kernels: polar tables, their convex hulls, and speed prediction from hull and rig."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewright.routing.geo import fold


@dataclass(frozen=True)
class Polar:
    """Speeds (m/s) by ascending twa and tws; bilinear, linearly extrapolated, no less than 0, none under the no-go angle."""

    twa: np.ndarray
    tws: np.ndarray
    speed: np.ndarray
    no_go: float = 0.0

    def __call__(self, twa, tws):
        a, w = fold(twa), np.maximum(tws, 0.0)
        i = np.clip(np.searchsorted(self.twa, a, "right") - 1, 0, len(self.twa) - 2)
        j = np.clip(np.searchsorted(self.tws, w, "right") - 1, 0, len(self.tws) - 2)
        ta, tw = (a - self.twa[i]) / (self.twa[i + 1] - self.twa[i]), (w - self.tws[j]) / (self.tws[j + 1] - self.tws[j])
        low = self.speed[i, j] + tw * (self.speed[i, j + 1] - self.speed[i, j])
        high = self.speed[i + 1, j] + tw * (self.speed[i + 1, j + 1] - self.speed[i + 1, j])
        return np.where(a < self.no_go, 0.0, np.maximum(0.0, low + ta * (high - low)))

    @staticmethod
    def of_rows(rows) -> Polar:
        """From (twa, tws, speed) rows of a full table."""
        twa, tws = (np.unique([r[k] for r in rows]) for k in (0, 1))
        speed = np.zeros((len(twa), len(tws)))
        for a, w, s in rows:
            speed[np.searchsorted(twa, a), np.searchsorted(tws, w)] = s
        return Polar(twa.astype(float), tws.astype(float), speed)


class Hull:
    """The convex hull of a polar at one wind speed, from whole degrees: what tacking between two headings can make good."""

    def __init__(self, polar: Polar, tws: float):
        a = np.radians(np.arange(0, 181))
        s = polar(np.degrees(a), np.full(181, tws))
        xy = np.stack([s * np.sin(a), s * np.cos(a)], 1)
        self.points = convex_hull(np.concatenate([xy, xy * [-1, 1]]))

    def speed(self, twa: float) -> tuple[float, tuple[float, float, float]]:
        """Speed made good along an angle, and the two headings (signed) and share of time on the first."""
        d = np.array([np.sin(np.radians(twa)), np.cos(np.radians(twa))])
        best = (0.0, (twa, twa, 1.0))
        p = self.points
        for a, b in zip(p, np.roll(p, -1, 0), strict=True):
            m = np.array([[d[0], a[0] - b[0]], [d[1], a[1] - b[1]]])
            if abs(np.linalg.det(m)) < 1e-12:
                continue
            r, t = np.linalg.solve(m, a)
            if -1e-9 <= t <= 1 + 1e-9 and r > best[0]:
                heading = lambda q: float(np.degrees(np.arctan2(q[0], q[1])))
                best = (float(r), (heading(a), heading(b), float(1 - min(max(t, 0.0), 1.0))))
        return best


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counterclockwise, without collinear points."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


@dataclass(frozen=True)
class Boat:
    """Hull and rig: waterline, beam and draught (m), displacement (kg), sail area up- and downwind (m²)."""

    lwl: float
    beam: float
    draught: float
    displacement: float
    area_up: float
    area_down: float

    @property
    def hull_speed(self) -> float:
        return 1.25 * np.sqrt(self.lwl)

    def drag(self, v):
        """Friction of the wetted surface, and waves that rise steeply near hull speed."""
        wetted = 1.9 * np.sqrt(self.displacement / 1025.0 * self.lwl) + 0.6 * self.lwl * self.beam * 0.5
        fr = v / np.maximum(self.hull_speed, 0.1)
        return 0.5 * 1025 * wetted * 0.0035 * v**2 + self.displacement * 9.81 * 0.02 * np.minimum(fr, 3.0) ** 4.5

    def drive(self, twa, tws, v):
        x, y = tws * np.cos(np.radians(twa)) + v, tws * np.sin(np.radians(twa))
        aws, awa = np.hypot(x, y), fold(np.degrees(np.arctan2(y, x)))
        rises = np.clip((awa - 20) / 70, 0, 1)
        coefficient = np.where(awa < 90, 1.35 * rises, 1.35 - 0.35 * np.clip((awa - 90) / 90, 0, 1))
        area = self.area_up + (self.area_down - self.area_up) * np.clip((awa - 60) / 60, 0, 1)
        heel = 1 / (1 + (aws / 14.0) ** 4)
        return 0.5 * 1.225 * area * coefficient * aws**2 * heel

    def speed(self, twa, tws, rounds: int = 40):
        """Where drive meets drag, by bisection."""
        twa, tws = np.broadcast_arrays(np.asarray(twa, float), np.asarray(tws, float))
        lo, hi = np.zeros(twa.shape), np.full(twa.shape, 2 * self.hull_speed)
        for _ in range(rounds):
            mid = (lo + hi) / 2
            more = self.drive(twa, tws, mid) > self.drag(mid)
            lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
        return np.where(twa < 25, 0.0, (lo + hi) / 2)

    def polar(self, twa=tuple(range(30, 181, 10)), tws=(3.0, 5.0, 7.0, 9.0, 12.0, 16.0)) -> Polar:
        a, w = np.meshgrid(twa, tws, indexing="ij")
        return Polar(np.array(twa, float), np.array(tws, float), self.speed(a, w))
