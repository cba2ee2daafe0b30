"""Plane geometry and projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]


def affine(a: float, b: float, d: float, e: float, xoff: float, yoff: float, x: Column, y: Column) -> tuple[Column, Column]:
    return x * a + y * b + xoff, x * d + y * e + yoff


def matrix(dx: float, dy: float, theta: float = 0.0, scale: float = 1.0) -> Affine:
    """Turn by theta (radians), scale, shift."""
    c, s = scale * math.cos(theta), scale * math.sin(theta)
    return c, -s, s, c, dx, dy


def similarity_fit(pairs: DataFrame, rotate: bool = True, scale: bool = True) -> dict:
    """The least-squares similarity that takes (x, y) to (u, v): scale, theta,
    matrix and root-mean-square error. Two passes of sums; fewer than two
    points only shift."""
    n, mx, my, mu, mv = pairs.agg(F.count("*"), F.avg("x"), F.avg("y"), F.avg("u"), F.avg("v")).first()
    if not n:
        raise ValueError("no control points")
    x, y, u, v = F.col("x") - mx, F.col("y") - my, F.col("u") - mu, F.col("v") - mv
    dot, cross, size = pairs.agg(F.sum(x * u + y * v), F.sum(x * v - y * u), F.sum(x * x + y * y)).first()
    theta = math.atan2(cross, dot) if rotate and n > 1 and size else 0.0
    factor = (dot * math.cos(theta) + cross * math.sin(theta)) / size if scale and n > 1 and size else 1.0
    a, b, d, e, _, _ = matrix(0, 0, theta, factor)
    m = (a, b, d, e, mu - a * mx - b * my, mv - d * mx - e * my)
    px, py = affine(*m, F.col("x"), F.col("y"))
    error = pairs.agg(F.avg((px - F.col("u")) ** 2 + (py - F.col("v")) ** 2)).first()[0]
    return {"scale": factor, "theta": theta, "matrix": m, "rms": math.sqrt(error), "n": n}


def extent_fit(points: DataFrame, box: tuple[float, float, float, float], scale: bool = False) -> Affine:
    """Moves the points' extent onto a box by their centres and, with scale, to
    its size (the mean of both sides)."""
    west, south, east, north = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    factor = ((box[2] - box[0]) / (east - west) + (box[3] - box[1]) / (north - south)) / 2 if scale and east > west and north > south else 1.0
    return factor, 0.0, 0.0, factor, (box[0] + box[2]) / 2 - factor * (west + east) / 2, (box[1] + box[3]) / 2 - factor * (south + north) / 2


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def angle_apart(a: Column, b: Column) -> Column:
    apart = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(apart, F.lit(360.0) - apart)


#: Lengths of a scale bar, in metres.
NICE_STEPS = (25, 50, 100, 200, 250, 500, 1000, 2000, 5000)


def scale_step(span: Column, share: float = 0.24) -> Column:
    """The length of a scale bar nearest to that share of a map's width, of
    equals the shorter."""
    steps = F.array(*[F.struct(F.abs(F.lit(s) - span * share).alias("off"), F.lit(s).alias("step")) for s in NICE_STEPS])
    return F.array_min(steps)["step"]


def polygon_area(ring: Column) -> Column:
    """Area of a ring of points (shoelace), whichever way round."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
    twice = F.aggregate(F.zip_with(ring, shifted, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda s, t: s + t)
    return F.abs(twice) / 2


def clip_convex(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one (half-plane by half-plane)."""
    turn = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(clip, clip[1:] + clip[:1], strict=True))
    clip = clip if turn < 0 else clip[::-1]
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        if not subject:
            break
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        out = []
        for i, p in enumerate(subject):
            q, s, t = subject[i - 1], side[i], side[i - 1]
            if (s >= 0) != (t >= 0):
                w = t / (t - s)
                out.append((q[0] + w * (p[0] - q[0]), q[1] + w * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        subject = out
    return subject


def ring_area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if ring else 0.0


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


# ---- transverse Mercator by Krueger's series -----------------------------
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in a zone (WGS84)."""
    c = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _RADIUS * x, (10_000_000 if south else 0) + _K0 * _RADIUS * y


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a zone (WGS84)."""
    xi, eta = (y - (10_000_000 if south else 0)) / (_K0 * _RADIUS), (x - 500000) / (_K0 * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BACK, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_LATITUDE, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)
