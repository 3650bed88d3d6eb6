"""Spatial operators over gates, roads, features and driven lines."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octroi.functions import text
from octroi.functions.geo import haversine, with_lambert
from octroi.operators.spatial import near_planar, near_points, nearest_point, points_near_polylines, polyline_segments

COLOCATED_M = 100.0
ALIAS_M = 500.0
ON_ROUTE_M = 300.0
FEATURE_M = 300.0
REENTRY_SECONDS, REENTRY_METRES = 180.0, 500.0
NAME_MATCH = 0.45
PROXIMITY_BOX_DEG = 0.01
PROXIMITY_PASS_M = 50.0


def _members(gates: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return gates.select(
        F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"), F.col("gare_id").alias(f"{side}_id"),
        *[F.col(c).alias(f"{side}_{c}") for c in columns],
    )


def transfer_pairs(gates: DataFrame, max_m: float = COLOCATED_M) -> DataFrame:
    """Gate pairs close enough to change between, a_id < b_id, typed by their operators."""
    g = gates.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        "gare_id", "lat", "lon", text.pipe_set("operators").alias("ops")
    )
    pairs = (
        near_points(g, g, max_m)
        .join(_members(g, "a", ["ops"]), ["a_lat", "a_lon"])
        .join(_members(g, "b", ["ops"]), ["b_lat", "b_lon"])
        .where("a_id < b_id")
    )
    boundary = ~F.arrays_overlap("a_ops", "b_ops")
    return pairs.select(
        "a_id", "b_id", "dist_m",
        F.when(boundary, "boundary").otherwise("exit_reentry").alias("transfer_type"),
        F.when(boundary, 0.0).otherwise(REENTRY_SECONDS).alias("dwell_s"),
        F.when(boundary, 0.0).otherwise(REENTRY_METRES).alias("dwell_m"),
        F.array_intersect("a_ops", "b_ops").alias("shared_operators"),
    )


def find_transfer(pairs: DataFrame, transfers: DataFrame) -> DataFrame:
    """The transfer of each unordered pair (from_gare_id, to_gare_id), where there is one."""
    key = pairs.select(
        "from_gare_id", "to_gare_id",
        F.least("from_gare_id", "to_gare_id").alias("a_id"), F.greatest("from_gare_id", "to_gare_id").alias("b_id"),
    )
    return key.join(transfers, ["a_id", "b_id"]).drop("a_id", "b_id")


def colocated_aliases(gates: DataFrame, radius_m: float = ALIAS_M) -> DataFrame:
    """(gare_id, alias_id): records of one physical place, itself included; road tags must not clash."""
    g = with_lambert(gates.where("lat IS NOT NULL AND lon IS NOT NULL")).select("gare_id", "x", "y", "primary_route")

    def side(p):
        return g.select(F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("gare_id").alias(f"{p}_id"), F.col("primary_route").alias(f"{p}_road"))

    road_a, road_b = F.coalesce("a_road", F.lit("")), F.coalesce("b_road", F.lit(""))
    return (
        near_planar(g, g, radius_m)
        .join(side("a"), ["ax", "ay"])
        .join(side("b"), ["bx", "by"])
        .where((F.col("a_id") == F.col("b_id")) | (road_a == "") | (road_b == "") | (road_a == road_b))
        .select(F.col("a_id").alias("gare_id"), F.col("b_id").alias("alias_id"))
    )


def alias_classes(gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gare_id, cls) and (cls, alias_cls): records with one place and one road tag share a class.

    Such records have the same aliases, so prices can be compared per class; copies of one record
    then cost one row instead of a row per pair.
    """
    g = with_lambert(gates.where("lat IS NOT NULL AND lon IS NOT NULL")).select("gare_id", "x", "y", F.coalesce("primary_route", F.lit("")).alias("primary_route"))
    reps = g.groupBy("x", "y", "primary_route").agg(F.min("gare_id").alias("cls"))
    member = g.join(reps, ["x", "y", "primary_route"]).select("gare_id", "cls")

    def side(p):
        return reps.select(F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("cls").alias(f"{p}_cls"), F.col("primary_route").alias(f"{p}_road"))

    fits = (F.col("a_road") == "") | (F.col("b_road") == "") | (F.col("a_road") == F.col("b_road"))
    pairs = near_planar(g, g, ALIAS_M).join(side("a"), ["ax", "ay"]).join(side("b"), ["bx", "by"]).where(fits)
    return member, pairs.select(F.col("a_cls").alias("cls"), F.col("b_cls").alias("alias_cls"))


def class_prices(gates: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gare_id, cls) and the highest price over all aliases of both ends per pair of classes."""
    member, alias = alias_classes(gates)

    def end(p, col):
        return member.select(F.col("gare_id").alias(col), F.col("cls").alias(p))

    between = (
        prices.join(end("x", "from_gare_id"), "from_gare_id").join(end("y", "to_gare_id"), "to_gare_id")
        .groupBy("x", "y").agg(F.max("price").alias("price"))
    )
    spread = (
        between.join(alias.select(F.col("alias_cls").alias("x"), F.col("cls").alias("a_cls")), "x")
        .join(alias.select(F.col("alias_cls").alias("y"), F.col("cls").alias("b_cls")), "y")
        .groupBy("a_cls", "b_cls").agg(F.max("price").alias("price"))
    )
    return member, spread


def alias_fare(pairs: DataFrame, gates: DataFrame, prices: DataFrame) -> DataFrame:
    """Highest price of each asked (from_gare_id, to_gare_id) over the aliases of both ends."""
    member, spread = class_prices(gates, prices)
    a = member.select(F.col("gare_id").alias("from_gare_id"), F.col("cls").alias("a_cls"))
    b = member.select(F.col("gare_id").alias("to_gare_id"), F.col("cls").alias("b_cls"))
    asked = pairs.select("from_gare_id", "to_gare_id").distinct()
    return asked.join(a, "from_gare_id").join(b, "to_gare_id").join(spread, ["a_cls", "b_cls"]).select("from_gare_id", "to_gare_id", "price")


def snap_to_road(gates: DataFrame, roads: DataFrame) -> DataFrame:
    """Nearest road vertex of every placed gate: snap_lat, snap_lon, snap_distance_m."""
    best = nearest_point(gates, roads)
    return gates.select("gare_id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").join(
        best.select(
            F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), F.col("b_lat").alias("snap_lat"),
            F.col("b_lon").alias("snap_lon"), F.col("dist_m").alias("snap_distance_m"),
        ),
        ["lat", "lon"],
    ).select("gare_id", "lat", "lon", "snap_lat", "snap_lon", "snap_distance_m")


def route_segments(vertices: DataFrame) -> DataFrame:
    return polyline_segments(with_lambert(vertices))


def gates_on_route(vertices: DataFrame, gates: DataFrame, radius_m: float = ON_ROUTE_M) -> DataFrame:
    """Gates within `radius_m` of each driven line with their position along it."""
    g = with_lambert(gates.where("lat IS NOT NULL AND lon IS NOT NULL"))
    hits = points_near_polylines(route_segments(vertices), g, radius_m)
    return hits.join(g.select("x", "y", "gare_id"), ["x", "y"]).select("route_id", "gare_id", "dist_m", "along_m")


def closest_other_gate(vertices: DataFrame, ends: DataFrame, places: DataFrame) -> DataFrame:
    """Closest gate point to each sampled route, its own two ends left out.

    `ends` is (route_id, origin_pid, destination_pid); `places` is (pid, lat, lon). Only gate points
    inside a box around a sampled vertex are looked at, as a grid join on box-sized cells.
    """
    n = vertices.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 200))
    box = F.lit(PROXIMITY_BOX_DEG)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    sampled = (
        vertices.join(n, "route_id")
        .where((F.col("seq") - 1) % step == 0)
        .select("route_id", "lat", "lon")
        .withColumn("_i", F.explode(F.transform(around, lambda d: F.floor(F.col("lat") / box) + d)))
        .withColumn("_j", F.explode(F.transform(around, lambda d: F.floor(F.col("lon") / box) + d)))
    )
    p = places.select(
        "pid", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"),
        F.floor(F.col("lat") / box).alias("_i"), F.floor(F.col("lon") / box).alias("_j"),
    )
    best = (
        sampled.join(p, ["_i", "_j"])
        .where((F.abs(F.col("lat") - F.col("g_lat")) <= box) & (F.abs(F.col("lon") - F.col("g_lon")) <= box))
        .join(ends, "route_id")
        .where("pid <> origin_pid AND pid <> destination_pid")
        .withColumn("d", haversine("lat", "lon", "g_lat", "g_lon"))
        .groupBy("route_id")
        .agg(F.min(F.struct("d", "pid")).alias("b"))
    )
    return ends.join(best, "route_id", "left").select(
        "route_id",
        F.col("b.pid").alias("closest_pid"),
        F.col("b.d").alias("closest_m"),
        F.coalesce(F.col("b.d") > PROXIMITY_PASS_M, F.lit(True)).alias("passed"),
    )


def features_in_radius(gates: DataFrame, features: DataFrame, radius_m: float = FEATURE_M) -> DataFrame:
    """Features near each placed gate; copies at one place are counted before the join."""
    stacked = features.groupBy(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).agg(F.count(F.lit(1)).alias("c"))
    near = near_points(gates, features, radius_m).join(stacked, ["b_lat", "b_lon"]).groupBy("a_lat", "a_lon").agg(F.sum("c").alias("c"))
    placed = gates.where("lat IS NOT NULL AND lon IS NOT NULL").select("gare_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    return placed.join(near, ["a_lat", "a_lon"], "left").select(
        "gare_id",
        F.coalesce("c", F.lit(0)).alias("n_features"),
        (F.coalesce("c", F.lit(0)) == 0).alias("no_infrastructure"),
    )


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings, 0..1; one Arrow batch at a time."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def poi_fuzzy_match(gates: DataFrame, pois: DataFrame, radius_m: float = FEATURE_M) -> DataFrame:
    """Best-named feature near each gate; each distinct pair of names is compared once."""
    placed = gates.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        "gare_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), text.lower_bare("canonical_name").alias("gate_name")
    )
    named = pois.select(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "poi_name", text.lower_bare("poi_name").alias("place_name")).distinct()
    pairs = (
        near_points(gates, pois, radius_m)
        .join(placed.select("a_lat", "a_lon", "gate_name").distinct(), ["a_lat", "a_lon"])
        .join(named, ["b_lat", "b_lon"])
    )
    scores = pairs.select("gate_name", "place_name").distinct().withColumn("score", name_similarity("gate_name", "place_name"))
    best = (
        pairs.join(scores, ["gate_name", "place_name"])
        .where("score > 0")
        .groupBy("a_lat", "a_lon", "gate_name")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "poi_name", "dist_m")).alias("b"))
    )
    return placed.join(best, ["a_lat", "a_lon", "gate_name"], "left").select(
        "gare_id",
        F.col("b.poi_name").alias("poi_name"),
        (-F.col("b.s")).alias("score"),
        F.round("b.dist_m").alias("poi_dist_m"),
        F.coalesce(-F.col("b.s") >= NAME_MATCH, F.lit(False)).alias("place_found"),
    )


def gate_detail_lookup(lists: DataFrame, gates: DataFrame, key: str, ids: str = "gates") -> DataFrame:
    """Attaches name, roads, tier and agreement to each id of a list, order kept."""
    info = gates.select("gare_id", F.col("canonical_name").alias("name"), F.col("all_routes").alias("routes"), "match_tier", "match_agreement")
    items = lists.select(key, F.posexplode(ids).alias("pos", "gare_id")).join(info, "gare_id", "left")
    return items.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "gare_id", "name", "routes", "match_tier", "match_agreement"))).alias("gate_detail")
    )


def signal_merge(gates: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """Left-merges per-gate signal tables; gates a check never saw get `<name>_error` = 'skipped'."""
    for name, table in signals.items():
        seen = table.withColumn("_seen", F.lit(True))
        gates = gates.join(seen, "gare_id", "left").withColumn(
            f"{name}_error", F.when(F.col("_seen").isNull(), "skipped").otherwise("")
        ).drop("_seen")
    return gates


def toll_free_delta(points: DataFrame, default_snap: DataFrame, free_snap: DataFrame, confirm_m: float = 200.0) -> DataFrame:
    """How much farther the toll-free road is than the nearest road; confirmed from `confirm_m` on."""
    a = default_snap.select("pid", F.col("dist_m").alias("default_m"))
    b = free_snap.select("pid", F.col("dist_m").alias("free_m"))
    return points.join(a, "pid").join(b, "pid").select(
        "pid", "default_m", "free_m",
        (F.col("free_m") - F.col("default_m")).alias("delta_m"),
        (F.col("free_m") - F.col("default_m") >= confirm_m).alias("confirmed"),
    )
