"""Distances, views and the transverse Mercator projection as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from legnet.functions.vec import vec


def measure(a: Column, b: Column) -> Column:
    """struct(horizontal, vertical, distance, bearing, gradient, ...) from a to b."""
    dx, dy, dz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
    flat = F.sqrt(dx * dx + dy * dy)
    bearing = F.degrees(F.atan2(dx, dy))
    bearing = F.when(bearing < 0.0, bearing + 360.0).otherwise(bearing)
    slope = F.degrees(F.atan2(dz, flat))
    percent = (
        F.when(slope > 89.99, float("inf"))
        .when(slope < -89.99, float("-inf"))
        .otherwise((100.0 * F.tan(F.radians(slope))).cast("int").cast("double"))
    )
    return F.struct(
        flat.alias("horizontal"),
        dz.alias("vertical"),
        F.sqrt(dx * dx + dy * dy + dz * dz).alias("distance"),
        bearing.alias("bearing"),
        (bearing * (400.0 / 360.0)).alias("bearing_grads"),
        slope.alias("gradient"),
        (slope * (400.0 / 360.0)).alias("gradient_grads"),
        percent.alias("gradient_percent"),
    )


def curve_place(axes: list[Column], corner: list[float], extent: float) -> Column:
    """Place on a space-filling curve (Z-order) of a cube from `corner`, 21 bits an axis.

    Points near each other mostly have near places, and a range of places is a box.
    """
    steps = F.lit((1 << 21) - 1)
    place = F.lit(0).cast("long")
    for i, (axis, low) in enumerate(zip(axes, corner)):
        part = (axis - F.lit(low)) / F.lit(extent or 1.0)
        bits = F.floor(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * steps).cast("long")
        # Two free bits before every bit, by halving the distance moved.
        for shift, mask in _SPREAD:
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        place = place.bitwiseOR(F.shiftleft(bits, i))
    return place


def _spread_masks() -> list[tuple[int, int]]:
    masks, group = [], 32
    while group > 1:
        group //= 2
        masks.append((group * 2, sum(1 << (3 * k + j) for k in range(0, 21, group) for j in range(min(group, 21 - k)))))
    return masks


_SPREAD = _spread_masks()


def project_view(p: Column, pan: float, tilt: float) -> Column:
    """Point turned so that x is right, y is up the page, z towards the viewer."""
    a, t = math.radians(pan), math.radians(tilt)
    right = p["x"] * math.cos(a) - p["y"] * math.sin(a)
    away = p["x"] * math.sin(a) + p["y"] * math.cos(a)
    return vec(
        right,
        p["z"] * math.cos(t) - away * math.sin(t),
        -(p["z"] * math.sin(t) + away * math.cos(t)),
    )


# WGS 84 ellipsoid and the UTM grid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0
UTM_SOUTH = 10000000.0


def _krueger():
    """Series coefficients of the projection, to fourth order in n."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    return n, a, alpha, beta, delta


def central_meridian(zone) -> Column:
    return F.radians(F.lit(zone) * 6.0 - 183.0)


def utm_to_lonlat(easting: Column, northing: Column, zone, south=False) -> Column:
    """struct(lon, lat) in degrees from a UTM position (WGS 84)."""
    _, a, _, beta, delta = _krueger()
    false_n = F.when(F.lit(south), UTM_SOUTH).otherwise(0.0)
    xi = (northing - false_n) / (UTM_SCALE * a)
    eta = (easting - UTM_EASTING) / (UTM_SCALE * a)
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = central_meridian(zone) + F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def _conformal(lat: Column) -> Column:
    """tan of the conformal latitude."""
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    s = F.sin(lat)
    return F.sinh(F.atanh(s) - e * F.atanh(e * s))


def lonlat_to_utm(lon: Column, lat: Column, zone, south=False) -> Column:
    """struct(easting, northing) in metres of a WGS 84 position in degrees."""
    _, a, alpha, _, _ = _krueger()
    t = _conformal(F.radians(lat))
    dl = F.radians(lon) - central_meridian(zone)
    xi0 = F.atan2(t, F.cos(dl))
    eta0 = F.atanh(F.sin(dl) / F.sqrt(1.0 + t * t))
    xi, eta = xi0, eta0
    for j, c in enumerate(alpha, 1):
        xi = xi + c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    false_n = F.when(F.lit(south), UTM_SOUTH).otherwise(0.0)
    return F.struct(
        (UTM_EASTING + UTM_SCALE * a * eta).alias("easting"),
        (false_n + UTM_SCALE * a * xi).alias("northing"),
    )


def convergence(lon: Column, lat: Column, zone) -> Column:
    """Meridian convergence in radians: angle from true north to grid north."""
    _, _, alpha, _, _ = _krueger()
    t = _conformal(F.radians(lat))
    dl = F.radians(lon) - central_meridian(zone)
    xi0 = F.atan2(t, F.cos(dl))
    eta0 = F.atanh(F.sin(dl) / F.sqrt(1.0 + t * t))
    p, q = F.lit(1.0), F.lit(0.0)
    for j, c in enumerate(alpha, 1):
        p = p + 2 * j * c * F.cos(2 * j * xi0) * F.cosh(2 * j * eta0)
        q = q + 2 * j * c * F.sin(2 * j * xi0) * F.sinh(2 * j * eta0)
    sphere = F.atan(t / F.sqrt(1.0 + t * t) * F.tan(dl))
    return sphere + F.atan2(q, p)
