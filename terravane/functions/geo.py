"""Geodesy and line of sight as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The GRS80 ellipsoid and the transverse Mercator zone of the results.
A, FLATTENING = 6378137.0, 1 / 298.257222101
SCALE, FALSE_EASTING, MERIDIAN = 0.9996, 500000.0, 27.0
# Metres of a degree, mean Earth radius, standard refraction.
DEGREE_M, EARTH_M, REFRACTION = 111320.0, 6371008.8, 0.13

N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
E = (FLATTENING * (2 - FLATTENING)) ** 0.5
#: Krueger's series, by powers of N: forward, inverse, and conformal to geodetic latitude.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15, 4279 * N**4 / 630)


def effective_radius(k: float = REFRACTION) -> float:
    return EARTH_M / (1 - k)


def to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) of degrees."""
    phi, dl = F.radians(lat), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - E * F.atanh(E * F.sin(phi)))
    x = F.atan(t / F.cos(dl))
    y = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    xi, eta = x, y
    for j, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2 * j * x) * F.cosh(2 * j * y)
        eta = eta + a * F.cos(2 * j * x) * F.sinh(2 * j * y)
    return FALSE_EASTING + SCALE * RECTIFYING * eta, SCALE * RECTIFYING * xi


def to_degrees(easting: Column, northing: Column) -> tuple[Column, Column]:
    """(lat, lon) of grid metres."""
    xi, eta = northing / (SCALE * RECTIFYING), (easting - FALSE_EASTING) / (SCALE * RECTIFYING)
    x, y = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(x) / F.cosh(y))))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), MERIDIAN + F.degrees(F.atan(F.sinh(y) / F.cos(x)))


def flat_metres(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Distance in the flat approximation, with the first point's latitude in the cosine."""
    north, east = (lat - other_lat) * DEGREE_M, (lon - other_lon) * DEGREE_M * F.cos(F.radians(lat))
    return F.sqrt(north * north + east * east)


def drop(d: Column, k: float = REFRACTION) -> Column:
    """How far the surface falls below the tangent plane at a distance."""
    return d * d / (2 * effective_radius(k))


def elevation(h: Column, eye: Column, d: Column, k: float = REFRACTION) -> Column:
    """Degrees above the horizontal at which a height is seen."""
    return F.degrees(F.atan2(h - eye - drop(d, k), d))


def dip_tangent(eye: Column) -> Column:
    """Tangent of the sea skyline; an eye lower than half a metre counts as that."""
    return -F.sqrt(2 * F.greatest(F.lit(0.5), eye) / effective_radius())


def best_tangent(ceiling: Column, eye: Column, near: Column, far: Column) -> Column:
    """The largest tangent that anything up to a ceiling can have between two distances."""
    above, r = ceiling - eye, effective_radius()
    at = F.when(above < 0, F.least(F.greatest(near, F.sqrt(2 * r * -above)), far)).otherwise(near)
    return above / at - at / (2 * r)


def refraction_state(h: Column, eye: Column, d: Column, skyline: Column) -> Column:
    """solid, normal, marginal or mirage: by which refraction (0.07, 0.13, 0.25) a height clears the skyline."""
    sees = [elevation(h, eye, d, k) > skyline for k in (0.07, 0.13, 0.25)]
    return F.when(sees[0], "solid").when(sees[1], "normal").when(sees[2], "marginal").otherwise("mirage")


def half_width(width: Column, d: Column) -> Column:
    """Degrees by which a silhouette reaches to either side."""
    return F.degrees(F.atan(width / (2 * d)))


def unwrapped(bearing: Column, centre: Column) -> Column:
    """Degrees from a centre, -180 to 180."""
    return F.pmod(bearing - centre + 180, F.lit(360.0)) - 180


def geometric_range(h1: Column, h2: Column) -> Column:
    """Kilometres at which two heights see each other over the sea."""
    return (2 * effective_radius()) ** 0.5 / 1000 * (F.sqrt(h1) + F.sqrt(h2))


def hidden(h: Column, eye: Column, d: Column, tangent: Column) -> Column:
    """Whether a height at a distance stays under a line of sight of a tangent."""
    return h <= eye + drop(d) + d * tangent


def in_window(bearing: Column, centre: Column, span: Column) -> Column:
    """Whether a bearing lies in a window of so many degrees around a centre, across north too."""
    return F.abs(unwrapped(bearing, centre)) <= span / 2


def bearing_span(bearings: Column, centre: Column) -> Column:
    """(from, to) of the bearings of a footprint's corners, unwrapped about its centre's."""
    turned = F.transform(bearings, lambda b: unwrapped(b, centre))
    return F.struct((centre + F.array_min(turned)).alias("from"), (centre + F.array_max(turned)).alias("to"))


def visible_part(top: Column, base: Column, line: Column) -> Column:
    """Degrees of a silhouette from base to top that rise over a line of sight; none is zero."""
    return F.greatest(F.lit(0.0), top - F.greatest(base, line))


def position_error(metres: Column, d: Column) -> Column:
    """Degrees by which a bearing is off if a position is off by so many metres."""
    return F.degrees(F.atan(metres / d))


def height_error(metres: Column, d: Column) -> Column:
    """Degrees by which an elevation is off if a height is off by so many metres."""
    return F.degrees(F.atan(metres / d))


def refraction_band(d: Column, low: float = 0.07, high: float = 0.25) -> Column:
    """Degrees between the elevations that weak and strong refraction give at a distance."""
    return F.degrees(F.atan((drop(d, low) - drop(d, high)) / d))


def deviation(radius_95: Column) -> Column:
    """The accuracy that a device reports, a radius of 95 %, as one standard deviation."""
    return radius_95 / 2


def _series(u2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    return a, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _arc_change(b, sin_s, cos_s, cos_2m):
    return b * sin_s * (cos_2m + b / 4 * (cos_s * (2 * cos_2m**2 - 1) - b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))


def _pair(a: str, b: str) -> T.StructType:
    return T.StructType([T.StructField(a, T.DoubleType()), T.StructField(b, T.DoubleType())])


@F.pandas_udf(_pair("lat", "lon"))
def direct(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The end of a geodesic from (lat, lon) at an bearing (degrees) and length (metres), after Vincenty."""
    minor = A * (1 - FLATTENING)
    for lat, lon, bearing, length in batches:
        az, u1 = np.radians(bearing.to_numpy()), np.arctan((1 - FLATTENING) * np.tan(np.radians(lat.to_numpy())))
        start = np.arctan2(np.tan(u1), np.cos(az))
        sin_a = np.cos(u1) * np.sin(az)
        cos2_a = 1 - sin_a**2
        a, b = _series(cos2_a * (A**2 - minor**2) / minor**2)
        plain = length.to_numpy() / (minor * a)
        s = plain
        for _ in range(100):
            new = plain + _arc_change(b, np.sin(s), np.cos(s), np.cos(2 * start + s))
            done = np.nanmax(np.abs(new - s), initial=0) < 1e-12
            s = new
            if done:
                break
        cos_2m = np.cos(2 * start + s)
        x = np.sin(u1) * np.sin(s) - np.cos(u1) * np.cos(s) * np.cos(az)
        phi = np.arctan2(np.sin(u1) * np.cos(s) + np.cos(u1) * np.sin(s) * np.cos(az), (1 - FLATTENING) * np.hypot(sin_a, x))
        lam = np.arctan2(np.sin(s) * np.sin(az), np.cos(u1) * np.cos(s) - np.sin(u1) * np.sin(s) * np.cos(az))
        c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
        dl = lam - (1 - c) * FLATTENING * sin_a * (s + c * np.sin(s) * (cos_2m + c * np.cos(s) * (2 * cos_2m**2 - 1)))
        yield pd.DataFrame({"lat": np.degrees(phi), "lon": lon.to_numpy() + np.degrees(dl)})


@F.pandas_udf(_pair("bearing", "metres"))
def inverse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Forward bearing and length of the geodesic between two points, after Vincenty. Equal points have both zero."""
    minor = A * (1 - FLATTENING)
    for lat1, lon1, lat2, lon2 in batches:
        u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x.to_numpy()))) for x in (lat1, lat2))
        whole = np.radians(lon2.to_numpy() - lon1.to_numpy())
        lam = whole
        with np.errstate(invalid="ignore", divide="ignore"):
            for _ in range(100):
                east, north = np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
                sin_s, cos_s = np.hypot(east, north), np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                s = np.arctan2(sin_s, cos_s)
                sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
                cos2_a = 1 - sin_a**2
                cos_2m = np.where(cos2_a == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a)
                c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
                new = whole + (1 - c) * FLATTENING * sin_a * (s + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
                done = np.nanmax(np.abs(new - lam), initial=0) < 1e-12
                lam = new
                if done:
                    break
            a, b = _series(cos2_a * (A**2 - minor**2) / minor**2)
            metres = minor * a * (s - _arc_change(b, sin_s, cos_s, cos_2m))
        yield pd.DataFrame({"bearing": np.where(sin_s == 0, 0.0, np.degrees(np.arctan2(east, north)) % 360), "metres": np.where(sin_s == 0, 0.0, metres)})
