"""Distance joins on grid keys: a range predicate becomes an equi-join plus an exact filter.

Both sides are reduced to distinct points before they meet, so many records at one place cost one
point. Callers join the point pairs back to their records on the coordinates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.functions.geo import EARTH_RADIUS_M, haversine


def _band(lat, step: float):
    return F.floor(lat / F.lit(step)).cast("bigint")


def _lon_width(band, step: float):
    """Longitude width of a cell in a latitude band; wide enough at the band's polar edge."""
    edge = F.greatest(F.abs(band * F.lit(step)), F.abs((band + 1) * F.lit(step)))
    return F.lit(step) / F.cos(F.radians(F.least(F.lit(89.0), edge)))


def near_points(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Distinct point pairs within `radius_m`: (a_lat, a_lon, b_lat, b_lon, dist_m).

    Both inputs carry `lat` and `lon`. The left point looks into the three latitude bands it
    can reach and, in each, only the longitude cells it can reach.
    """
    step = math.degrees(radius_m / EARTH_RADIUS_M) * 1.0001 + 1e-9
    a = left.select(F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).na.drop().distinct()
    b = right.select(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).na.drop().distinct()
    b = (
        b.withColumn("_band", _band(F.col("b_lat"), step))
        .withColumn("_cell", F.floor(F.col("b_lon") / _lon_width(F.col("_band"), step)).cast("bigint"))
    )
    reach = F.lit(step) / F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("a_lat")) + step)))
    width = _lon_width(F.col("_band"), step)
    a = (
        a.withColumn("_mid", _band(F.col("a_lat"), step))
        .withColumn("_band", F.explode(F.sequence(F.col("_mid") - 1, F.col("_mid") + 1)))
        .withColumn(
            "_cell",
            F.explode(
                F.sequence(
                    F.floor((F.col("a_lon") - reach) / width).cast("bigint"),
                    F.floor((F.col("a_lon") + reach) / width).cast("bigint"),
                )
            ),
        )
        .drop("_mid")
    )
    return (
        a.join(b, ["_band", "_cell"])
        .withColumn("dist_m", haversine("a_lat", "a_lon", "b_lat", "b_lon"))
        .where(F.col("dist_m") <= radius_m)
        .select("a_lat", "a_lon", "b_lat", "b_lon", "dist_m")
    )


def near_planar(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Distinct planar point pairs within `radius_m`: (ax, ay, bx, by, dist_m); inputs carry x, y."""
    a = left.select(F.col("x").alias("ax"), F.col("y").alias("ay")).na.drop().distinct()
    b = right.select(F.col("x").alias("bx"), F.col("y").alias("by")).na.drop().distinct()
    b = b.withColumn("_cx", F.floor(F.col("bx") / radius_m)).withColumn("_cy", F.floor(F.col("by") / radius_m))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = (
        a.withColumn("_cx", F.explode(F.transform(around, lambda d: F.floor(F.col("ax") / radius_m) + d)))
        .withColumn("_cy", F.explode(F.transform(around, lambda d: F.floor(F.col("ay") / radius_m) + d)))
    )
    return (
        a.join(b, ["_cx", "_cy"])
        .withColumn("dist_m", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
        .where(F.col("dist_m") <= radius_m)
        .select("ax", "ay", "bx", "by", "dist_m")
    )


def nearest_point(left: DataFrame, right: DataFrame, first_radius_m: float = 500.0, growth: float = 8.0) -> DataFrame:
    """Nearest right point of every distinct left point: (a_lat, a_lon, b_lat, b_lon, dist_m).

    A point found inside a ring is final, because anything nearer lies in the same ring. Points
    without a hit go on with a wider ring until the ring spans the globe, so none is lost.
    """
    found = None
    todo = left.select("lat", "lon").na.drop().distinct()
    radius = first_radius_m
    half_turn = math.pi * EARTH_RADIUS_M
    while True:
        pairs = near_points(todo, right, min(radius, half_turn))
        best = pairs.groupBy("a_lat", "a_lon").agg(
            F.min(F.struct("dist_m", "b_lat", "b_lon")).alias("_best")
        )
        best = best.select("a_lat", "a_lon", "_best.b_lat", "_best.b_lon", "_best.dist_m")
        found = best if found is None else found.unionByName(best)
        if radius >= half_turn:
            return found
        todo = todo.join(
            best.select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")), ["lat", "lon"], "left_anti"
        )
        if todo.isEmpty():
            return found
        radius *= growth


# --- rings -----------------------------------------------------------------------------------


def _turns(band, step: float):
    """Cells of a latitude band around the globe: each at least `step` degrees of latitude wide at its polar edge."""
    edge = F.greatest(F.abs(band * step - 90.0), F.abs((band + 1) * step - 90.0))
    return F.greatest(F.lit(1), F.floor(360.0 / step * F.cos(F.radians(F.least(F.lit(90.0), edge))))).cast("bigint")


def with_globe_cell(df: DataFrame, lat: str, lon: str, step: float) -> DataFrame:
    """Adds `band` and `cell`; cells close around the globe, so nothing ends at the date line."""
    df = df.withColumn("band", F.floor((F.col(lat) + 90.0) / step).cast("bigint"))
    return df.withColumn("cell", F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / 360.0 * _turns(F.col("band"), step)).cast("bigint"))


def cell_centre(step: float):
    """(lat, lon) of the middle of `band`, `cell`."""
    return (F.col("band") + 0.5) * step - 90.0, (F.col("cell") + 0.5) * 360.0 / _turns(F.col("band"), step) - 180.0


def ring_join(left: DataFrame, right: DataFrame, lo: float, hi: float, step: float, radius: float = EARTH_RADIUS_M) -> DataFrame:
    """Rows of both sides whose distance lies in [lo, hi], as `dist`; points are a_lat, a_lon and b_lat, b_lon.

    A left point looks only into cells that its ring crosses: in each latitude band, east and west of it, those
    between the longitude offset below which all of the band is too near and the one beyond which all is too far.
    Offsets come from hav(d) = hav(lat) + cos cos hav(lon), with the band's own extremes put in.
    """
    hav = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))  # noqa: E731  of degrees
    slack = 1e-7
    near_deg, far_deg = (F.lit(math.degrees(min(math.pi, d / radius))) for d in (lo, hi))
    lat, lon, band = F.col("a_lat"), F.col("a_lon"), F.col("band")
    top = int(180.0 / step)
    first = F.greatest(F.lit(0), F.floor((lat + 90.0 - far_deg - slack) / step)).cast("bigint")
    last = F.least(F.lit(top), F.floor((lat + 90.0 + far_deg + slack) / step)).cast("bigint")
    south, north = band * step - 90.0, (band + 1) * step - 90.0
    closest = F.greatest(south - lat, lat - north, F.lit(0.0))
    furthest = F.greatest(F.abs(lat - south), F.abs(lat - north))
    thin = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(north)))))
    wide = F.when((south < 0) & (north > 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(south), F.abs(north)))))
    own = F.cos(F.radians(lat))

    def offset(limit, spent, cos_b):
        share = (hav(limit) - hav(spent)) / F.greatest(own * cos_b, F.lit(1e-15))
        return F.degrees(2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))))

    outer = F.least(F.lit(180.0), offset(far_deg + slack, closest, thin) + slack)
    inner = F.greatest(F.lit(0.0), offset(F.greatest(F.lit(0.0), near_deg - slack), furthest, wide) - slack)
    at = lambda x: F.floor((lon + 180.0 + x) / 360.0 * F.col("_turns")).cast("bigint")
    # no cell twice: the west side ends before the east side begins, and neither goes past the other around the globe
    sides = F.concat(F.sequence("_e0", "_e1"), F.when(F.col("_w0") <= F.col("_w1"), F.sequence("_w0", "_w1")).otherwise(F.array().cast("array<bigint>")))
    a = left.where("a_lat is not null and a_lon is not null").withColumn("band", F.explode(F.sequence(first, last)))
    a = a.withColumns({"_inner": inner, "_outer": outer, "_turns": _turns(band, step)}).where("_inner <= _outer")
    a = a.withColumns({"_e0": at(F.col("_inner")), "_far": at(F.col("_outer"))})
    a = a.withColumns({"_e1": F.least(F.col("_far"), F.col("_e0") + F.col("_turns") - 1)})
    a = a.withColumns({"_w0": F.greatest(at(-F.col("_outer")), F.col("_e1") - F.col("_turns") + 1), "_w1": F.least(at(-F.col("_inner")), F.col("_e0") - 1)})
    a = a.withColumn("cell", F.explode(sides)).withColumn("cell", F.pmod("cell", "_turns")).drop("_inner", "_outer", "_turns", "_e0", "_e1", "_far", "_w0", "_w1")
    b = with_globe_cell(right.where("b_lat is not null and b_lon is not null"), "b_lat", "b_lon", step)
    met = a.join(b, ["band", "cell"]).withColumn("dist", haversine("a_lat", "a_lon", "b_lat", "b_lon", radius))
    return met.where(F.col("dist").between(lo, hi)).drop("band", "cell")


# --- polylines -------------------------------------------------------------------------------

ROUTE_BLOCK = 4096


def polyline_segments(vertices: DataFrame, route: list[str] = ["route_id"]) -> DataFrame:
    """Segments of projected polylines with the length driven before each: x1, y1, x2, y2, len_m, start_m.

    `vertices` carries the route key, a dense 1-based `seq`, x and y. The next vertex comes by an
    equi-join on seq + 1 and the cumulative length from block totals, so one very long route is
    spread over many tasks.
    """
    from octroi.operators.ranking import running_total

    here = vertices.select(*route, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    nxt = vertices.select(*route, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    seg = here.join(nxt, [*route, "seq"]).withColumn(
        "len_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    )
    block = F.floor(F.col("seq") / F.lit(ROUTE_BLOCK))
    return running_total(seg, route, "seq", block, "len_m", "start_m")


PIECE_M = 5_000.0


def points_near_polylines(
    segments: DataFrame, points: DataFrame, radius_m: float, route: list[str] = ["route_id"], own: list[str] | None = None
) -> DataFrame:
    """(route, x, y, dist_m, along_m) for every distinct point within `radius_m` of a route.

    Long segments are cut into pieces of at most 5 km; a piece looks only into the grid cells its
    grown bounding box touches. With `own`, a point belongs to one line and is compared with that
    line only. dist_m is rounded to the millimetre and ties take the first
    position along the route.
    """
    cell = F.lit(max(PIECE_M, radius_m))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = (
        segments.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("len_m") / PIECE_M)).cast("int"))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_t0", F.col("_i") / F.col("_n"))
        .withColumn("_t1", (F.col("_i") + 1) / F.col("_n"))
    )
    ax, bx = F.col("x1") + dx * F.col("_t0"), F.col("x1") + dx * F.col("_t1")
    ay, by = F.col("y1") + dy * F.col("_t0"), F.col("y1") + dy * F.col("_t1")

    def cells(p, q):
        return F.sequence(
            F.floor((F.least(p, q) - radius_m) / cell).cast("bigint"),
            F.floor((F.greatest(p, q) + radius_m) / cell).cast("bigint"),
        )

    pieces = pieces.withColumn("_cx", F.explode(cells(ax, bx))).withColumn("_cy", F.explode(cells(ay, by)))
    pts = (
        points.select(*(own or []), "x", "y").na.drop().distinct()
        .withColumn("_cx", F.floor(F.col("x") / cell).cast("bigint"))
        .withColumn("_cy", F.floor(F.col("y") / cell).cast("bigint"))
    )
    proj = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (F.col("len_m") * F.col("len_m"))
    t = F.when(F.col("len_m") > 0, F.least(F.col("_t1"), F.greatest(F.col("_t0"), proj))).otherwise(F.lit(0.0))
    hit = (
        pieces.join(pts, [*(own or []), "_cx", "_cy"])
        .withColumn("_t", t)
        .withColumn(
            "dist_m",
            F.round(
                F.hypot(F.col("x") - F.col("x1") - F.col("_t") * dx, F.col("y") - F.col("y1") - F.col("_t") * dy), 3
            ),
        )
        .where(F.col("dist_m") <= radius_m)
        .withColumn("along_m", F.col("start_m") + F.col("_t") * F.col("len_m"))
    )
    best = hit.groupBy(*route, "x", "y").agg(F.min(F.struct("dist_m", "along_m")).alias("_b"))
    return best.select(*route, "x", "y", "_b.dist_m", "_b.along_m")
