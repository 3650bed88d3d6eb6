"""Cost and time/money trade-off expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indicative class defaults, class -> (EUR per km, EUR per hour).
CLASS_DEFAULTS = {1: (0.15, 12.0), 2: (0.20, 15.0), 3: (0.25, 30.0), 4: (0.30, 50.0), 5: (0.10, 10.0)}

# Price of classes 2..5 over class 1.
CLASS_RATIOS = {2: 1.5466, 3: 2.4801, 4: 3.3333, 5: 0.5849}

FALLBACK_SPEED_KMH = 110.0
VOT_MIN, VOT_MAX, VOT_STEPS = 1.0, 100.0, 10
DETOUR_MIN_KM, DETOUR_MIN_MINUTES = 10.0, 5.0


def generalised_cost(toll, distance_m, duration_s, per_km, per_hour) -> Column:
    return toll + distance_m / F.lit(1000.0) * per_km + duration_s / F.lit(3600.0) * per_hour


def vot_grid(lo: float = VOT_MIN, hi: float = VOT_MAX, steps: int = VOT_STEPS) -> Column:
    """Log-spaced values of time as an array; one step means the lower end alone."""
    a, b = F.log10(F.lit(float(lo))), F.log10(F.lit(float(hi)))
    gaps = F.lit(float(max(steps - 1, 1)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.pow(F.lit(10.0), a + i * (b - a) / gaps)
    )


def fallback_seconds(distance_m) -> Column:
    """Driving time at the fallback motorway speed."""
    return distance_m / F.lit(FALLBACK_SPEED_KMH * 1000.0 / 3600.0)


def relative_error(measured, stated) -> Column:
    return F.when(stated != 0, (measured - stated) / stated)


def percent_error(measured, stated) -> Column:
    return relative_error(measured, stated) * 100.0


def extra_km(distance_m, fast_distance_m) -> Column:
    return (distance_m - fast_distance_m) / F.lit(1000.0)


def extra_minutes(duration_s, fast_duration_s) -> Column:
    return (duration_s - fast_duration_s) / F.lit(60.0)


def eur_per_hour_saved(saving, minutes) -> Column:
    """Money saved per hour given up: infinite for a free gain, NULL when nothing is gained."""
    return (
        F.when(minutes > 1e-9, saving / (minutes / F.lit(60.0)))
        .when(saving > 0, F.lit(float("inf")))
    )


def detour_floor(km, minutes) -> Column:
    return (km >= DETOUR_MIN_KM) | (minutes >= DETOUR_MIN_MINUTES)


def worthwhile(rate, threshold) -> Column:
    return F.coalesce(rate >= threshold, F.lit(False))


def vot_bucket(vot) -> Column:
    """Whole EUR/h, halves to even."""
    return F.bround(vot, 0).cast("bigint")


def route_fingerprint(olat, olon, dlat, dlon, gates) -> Column:
    """16 hex digits naming one origin, destination and gate chain."""
    key = F.concat(
        F.format_string("%.5f,%.5f|%.5f,%.5f|", olat, olon, dlat, dlon),
        F.array_join(F.transform(gates, lambda g: g.cast("string")), ","),
    )
    return F.substring(F.sha1(key), 1, 16)
