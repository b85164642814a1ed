"""Great circles on numpy arrays, for kernels. Degrees and metres."""

from __future__ import annotations

import numpy as np

R = 6_371_000.0


def haversine(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def bearing(lon1, lat1, lon2, lat2):
    p1, p2, d = np.radians(lat1), np.radians(lat2), np.radians(np.subtract(lon2, lon1))
    return np.degrees(np.arctan2(np.sin(d) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(d))) % 360.0


def destination(lon, lat, course, metres):
    p, b, d = np.radians(lat), np.radians(course), np.divide(metres, R)
    lat2 = np.arcsin(np.clip(np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(b), -1, 1))
    lon2 = np.radians(lon) + np.arctan2(np.sin(b) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * np.sin(lat2))
    return (np.degrees(lon2) + 180.0) % 360.0 - 180.0, np.degrees(lat2)


def cross_track(s_lon, s_lat, e_lon, e_lat, lon, lat):
    d = haversine(s_lon, s_lat, lon, lat) / R
    return np.arcsin(np.clip(np.sin(d) * np.sin(np.radians(bearing(s_lon, s_lat, lon, lat) - bearing(s_lon, s_lat, e_lon, e_lat))), -1, 1)) * R


def fold(a):
    a = np.mod(a, 360.0)
    return np.minimum(a, 360.0 - a)
