"""The projection, as a column expression.  Polygons are arrays of polygons of rings of [x, y]; see operators/cover.py."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGONS = "array<array<array<array<double>>>>"

# WGS 84 and the transverse Mercator projection of UTM.
A, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def _series() -> tuple[float, list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    mean_radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return mean_radius, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]


def utm_project(lon: Column, lat: Column, zone: int, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres, by the Krueger series (within a millimetre near the zone)."""
    radius, alpha = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6.0 - 183.0))
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - F.lit(e) * F.atanh(F.lit(e) * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(FALSE_EASTING) + F.lit(SCALE * radius) * x, F.lit(FALSE_NORTHING * south) + F.lit(SCALE * radius) * y
