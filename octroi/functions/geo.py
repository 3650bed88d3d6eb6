"""Distance and projection expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
EARTH_RADIUS_KM = 6_371.0

# Lambert-93 (EPSG:2154) cone parameters published by IGN.
L93_N = 0.7256077650532670
L93_C = 11754255.4261
L93_XS = 700000.0
L93_YS = 12655612.0499
L93_E = 0.0818191910428158
L93_LON0 = 3.0


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in the unit of `radius`; NULL where a coordinate is missing."""
    a1, o1, a2, o2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    half = (
        F.pow(F.sin(F.radians(a2 - a1) / 2), F.lit(2.0))
        + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.pow(F.sin(F.radians(o2 - o1) / 2), F.lit(2.0))
    )
    # A plain LEAST would skip a NULL and turn a missing coordinate into half the globe.
    return F.lit(2 * radius) * F.asin(F.when(half > 1.0, F.lit(1.0)).otherwise(F.sqrt(half)))


def _conic(lat, lon) -> tuple[Column, Column]:
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    s = F.sin(F.radians(lat))
    iso = F.atanh(s) - F.lit(L93_E) * F.atanh(F.lit(L93_E) * s)
    return F.lit(L93_C) * F.exp(-F.lit(L93_N) * iso), F.lit(L93_N) * F.radians(lon - F.lit(L93_LON0))


def lambert_x(lat, lon) -> Column:
    r, g = _conic(lat, lon)
    return F.lit(L93_XS) + r * F.sin(g)


def lambert_y(lat, lon) -> Column:
    r, g = _conic(lat, lon)
    return F.lit(L93_YS) - r * F.cos(g)


def with_lambert(df, lat: str = "lat", lon: str = "lon"):
    return df.withColumn("x", lambert_x(lat, lon)).withColumn("y", lambert_y(lat, lon))


def overshoot_corrected(distance_m, dest_lat, min_lat) -> Column:
    """Distance less the return trip beyond the destination latitude (111 km per degree)."""
    return distance_m - F.lit(2.0) * F.greatest(F.lit(0.0), dest_lat - min_lat) * F.lit(111_000.0)


def roughly_equal(a, b, rel: float = 0.1) -> Column:
    """Relative closeness against the larger magnitude."""
    return F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))
