"""Projection, points in polygons and lines that meet them, one after another: what the covering index is held against."""

from __future__ import annotations

import math

import numpy as np

from waymetric.functions.geometry import FALSE_EASTING, FALSE_NORTHING, FLATTENING, SCALE, _series


def utm_arrays(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same projection for the vertices of polygons."""
    radius, alpha = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    sin, lam = np.sin(np.radians(lat)), np.radians(lon - (zone * 6.0 - 183.0))
    t = np.sinh(np.arctanh(sin) - e * np.arctanh(e * sin))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(alpha, 1):
        x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * radius * x, FALSE_NORTHING * south + SCALE * radius * y


def rings_of(polygons) -> list[np.ndarray]:
    return [np.asarray([list(p) for p in ring], float) for polygon in polygons for ring in polygon if len(ring) > 1]


def within(px: np.ndarray, py: np.ndarray, rings: list[np.ndarray], tolerance: float) -> np.ndarray:
    """Points inside by the even-odd rule, or nearer than tolerance to the boundary."""
    inside, near = np.zeros(len(px), bool), np.full(len(px), np.inf)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
            if y0 != y1:
                inside ^= ((y0 > py) != (y1 > py)) & (px < x0 + (py - y0) * (x1 - x0) / (y1 - y0))
            dx, dy = x1 - x0, y1 - y0
            along = np.clip(((px - x0) * dx + (py - y0) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
            near = np.minimum(near, np.hypot(px - x0 - along * dx, py - y0 - along * dy))
    return inside | (near < tolerance)


def line_meets(line: np.ndarray, rings: list[np.ndarray]) -> bool:
    """Whether a line of points touches or crosses the area of the rings."""
    if within(line[:, 0], line[:, 1], rings, 1e-12).any():
        return True
    cross = lambda o, a, b: (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])
    p, q = line[:-1, None, :], line[1:, None, :]
    for ring in rings:
        a, b = ring[None, :-1, :], ring[None, 1:, :]
        # segments on one line cross nowhere else than where their boxes meet
        boxes = ((np.minimum(p, q) <= np.maximum(a, b)) & (np.minimum(a, b) <= np.maximum(p, q))).all(-1)
        if (boxes & (cross(p, q, a) * cross(p, q, b) <= 0) & (cross(a, b, p) * cross(a, b, q) <= 0) & (p != q).any(-1)).any():
            return True
    return False
