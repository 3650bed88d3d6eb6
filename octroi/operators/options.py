"""Shaping of routes into labelled options per (origin, destination, class, bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.functions import paths, pricing
from octroi.plans.requests import BEST_BASE, FASTEST, GROUP

PAIR = ["origin_id", "destination_id", "vehicle_class"]
ROUTE = ["mode", "cost", "toll", "distance_m", "duration_s", "path", "last_m", "chain"]
MAX_ACCESS_SHARE = 0.5
MAX_TOLL_HOPS = 5
# Display order of labels.
LABEL_ORDER = {"fastest": 0, "cheapest": 1, "toll_optimised": 2, "toll_free_route": 3}


def with_chain(routes: DataFrame) -> DataFrame:
    return routes.withColumn("chain", paths.gate_chain("path"))


def dedupe_by_chain(routes: DataFrame) -> DataFrame:
    """Sweep routes, the first in value-of-time order per (pair, chain)."""
    sweep = routes.where(f"mode > {FASTEST} AND mode < {BEST_BASE}")
    first = sweep.groupBy(*PAIR, "chain").agg(F.min(F.struct(*[c for c in ROUTE if c != "chain"])).alias("r"))
    return first.select(*PAIR, "r.*", "chain")


def access_heavy(route):
    """The leg into the destination makes up more than half of the way."""
    return F.coalesce(route["last_m"] / F.nullif(route["distance_m"], F.lit(0.0)) > MAX_ACCESS_SHARE, F.lit(False))


def picks(groups: DataFrame, routes: DataFrame) -> DataFrame:
    """Per group the fastest and best route, the cheapest priced one, and all toll-free frontier routes.

    A group holds at most the sweep's handful of routes, so its frontier fits in one small array.
    """
    route = F.struct(*ROUTE)
    frontier = dedupe_by_chain(routes)
    fast = routes.where(f"mode = {FASTEST}").select(*PAIR, route.alias("fast"))
    best = routes.where(f"mode >= {BEST_BASE}").select(
        *PAIR, (F.col("mode") - BEST_BASE).alias("vot_bucket"), route.alias("best")
    )
    sides = frontier.groupBy(*PAIR).agg(
        F.min(F.when(F.col("toll") > 0, F.struct(F.col("toll").alias("t"), F.col("mode").alias("m"), route.alias("r"))))["r"].alias("cheap"),
        F.array_sort(F.collect_list(F.when(F.col("toll") == 0, route))).alias("free"),
    )
    return groups.join(best, GROUP).join(fast, PAIR).join(sides, PAIR, "left")


def cheapest_guard(picked: DataFrame) -> DataFrame:
    """Adds `cheap_ok`: the cheapest route may be shown, by its access share and its overlap with the others."""
    c = F.col("cheap")
    same_best, same_fast = c["chain"] == F.col("best.chain"), c["chain"] == F.col("fast.chain")
    ok = c.isNotNull() & ~access_heavy(c) & (same_best | ~same_fast)
    return picked.withColumn("cheap_ok", F.coalesce(ok, F.lit(False)))


def label_options(picked: DataFrame) -> DataFrame:
    """One row per (group, chain): its labels and the route registered first for it."""
    def entry(r, label, rank):
        return F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label"), r.alias("r"))

    shown = cheapest_guard(picked)
    fast = F.col("fast")
    km = lambda r: pricing.extra_km(r["distance_m"], fast["distance_m"])
    minutes = lambda r: pricing.extra_minutes(r["duration_s"], fast["duration_s"])
    taken = lambda r: (
        (r["chain"] == fast["chain"]) | (r["chain"] == F.col("best.chain"))
        | (F.col("cheap_ok") & F.coalesce(r["chain"] == F.col("cheap.chain"), F.lit(False)))
    )
    free = F.filter(
        F.coalesce("free", F.array()), lambda r: ~taken(r) & pricing.detour_floor(km(r), minutes(r))
    )
    entries = F.concat(
        F.array(entry(fast, "fastest", 0), entry(F.col("best"), "toll_optimised", 1)),
        F.filter(F.array(F.when(F.col("cheap_ok"), entry(F.col("cheap"), "cheapest", 2))), lambda v: v.isNotNull()),
        F.transform(free, lambda r: entry(r, "toll_free_route", 3)),
    )
    rows = shown.withColumn("entries", entries).select(*GROUP, "fast", F.explode("entries").alias("e"))
    labelled = rows.groupBy(*GROUP, F.col("e.r.chain").alias("chain")).agg(
        F.array_sort(F.collect_set("e.label")).alias("labels"),
        F.min(F.struct("e.rank", "e.r")).getField("r").alias("route"),
        F.first("fast").alias("fast"),
    )
    return labelled


def option_rows(labelled: DataFrame) -> DataFrame:
    """Totals, savings against the fastest and display rank of every option."""
    extra_min = pricing.extra_minutes(F.col("route.duration_s"), F.col("fast.duration_s"))
    saving = F.col("fast.toll") - F.col("route.toll")
    ranks = F.create_map(*[v for k, n in LABEL_ORDER.items() for v in (F.lit(k), F.lit(n))])
    return labelled.select(
        *GROUP, "chain", "labels",
        F.col("route.toll").alias("toll_eur"), F.col("route.duration_s").alias("duration_s"), F.col("route.distance_m").alias("distance_m"),
        F.col("route.path").alias("path"), F.col("route.last_m").alias("last_m"),
        saving.alias("saving_vs_fastest_eur"),
        extra_min.alias("extra_minutes"),
        pricing.extra_km(F.col("route.distance_m"), F.col("fast.distance_m")).alias("extra_km"),
        pricing.eur_per_hour_saved(saving, extra_min).alias("eur_per_hour_saved"),
        F.array_min(F.transform("labels", lambda v: ranks[v])).alias("label_rank"),
    )


def option_order(options: DataFrame) -> DataFrame:
    """Adds `option_no`: by label rank, then toll, then time. A group has a handful of options."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*GROUP).orderBy("label_rank", "toll_eur", "duration_s", "chain")
    return options.withColumn("option_no", F.row_number().over(w))


OPTION = [*GROUP, "chain"]


def leg_details(options: DataFrame, costs: DataFrame, gates: DataFrame) -> DataFrame:
    """One row per toll leg of every option: ends, operator, price, names and roads."""
    classes = F.array(*[F.col(f"class{k}") for k in range(1, 6)])
    toll = costs.where("edge_type = 'toll'").select(
        F.floor(F.col("from_node") / 4).alias("from_gare_id"), F.floor(F.col("to_node") / 4).alias("to_gare_id"),
        "operator", classes.alias("by_class"),
    )
    legs = options.select(*OPTION, F.explode(paths.toll_legs("path")).alias("l")).select(
        *OPTION, "l.pos", "l.from_gare_id", "l.to_gare_id"
    )
    rows = legs.join(toll, ["from_gare_id", "to_gare_id"]).withColumn(
        "price", F.element_at("by_class", F.col("vehicle_class").cast("int"))
    )
    for side in ("from", "to"):
        g = gates.select(
            F.col("gare_id").alias(f"{side}_gare_id"), F.col("canonical_name").alias(f"{side}_name"), F.col("all_routes").alias(f"{side}_roads")
        )
        rows = rows.join(g, f"{side}_gare_id", "left")
    roads = F.array_join(F.filter(F.array("from_roads", "to_roads"), lambda v: v.isNotNull() & (v != "")), "|")
    return rows.select(*OPTION, "pos", "from_gare_id", "to_gare_id", "operator", "price", "from_name", "to_name", roads.alias("roads"))


def option_details(options: DataFrame, costs: DataFrame, gates: DataFrame) -> DataFrame:
    """Options with their toll legs as arrays: all operators, priced legs, priced gates, leg places."""
    legs = leg_details(options, costs, gates)
    leg = F.struct("pos", "from_gare_id", "to_gare_id", "operator", "price", "from_name", "to_name", "roads")
    per = legs.groupBy(*OPTION).agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    none = F.array().cast(
        "array<struct<pos:int,from_gare_id:bigint,to_gare_id:bigint,operator:string,price:double,from_name:string,to_name:string,roads:string>>"
    )
    full = options.join(per, OPTION, "left").withColumn("legs", F.coalesce("legs", none))
    priced = F.filter("legs", lambda v: v["price"] > 0)
    return (
        full.withColumn("toll_gates_detail", priced)
        .withColumn("toll_segments", F.transform("toll_gates_detail", lambda v: v["price"]))
        .withColumn("toll_leg_indices", paths.leg_indices("chain", F.transform("toll_gates_detail", lambda v: v["to_gare_id"])))
        .withColumn("priced_gates", paths.priced_gates("toll_gates_detail"))
        .withColumn("same_operator_split", paths.same_operator_split(F.transform("legs", lambda v: v["operator"])))
    )


def waypoint_legs(detailed: DataFrame, hubs: DataFrame, gates: DataFrame) -> DataFrame:
    """Route id, waypoints (origin, priced gates, destination) and which legs between them are priced."""
    def hub(side):
        return hubs.select(F.col("hub_id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))

    rows = detailed.join(hub("origin"), "origin_id").join(hub("destination"), "destination_id")
    # Leg j+1 leaves priced gate j.
    priced_legs = F.array_sort(
        F.array_distinct(
            F.transform("toll_gates_detail", lambda v: F.array_position(F.col("priced_gates"), v["from_gare_id"]).cast("int"))
        )
    )
    place = gates.select("gare_id", "lat", "lon")
    spots = (
        rows.select(*OPTION, F.posexplode("priced_gates").alias("pos", "gare_id"))
        .join(place, "gare_id")
        .groupBy(*OPTION)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("s"))
    )
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    middle = F.coalesce(F.transform("s", lambda v: point(v["lat"], v["lon"])), none)
    return (
        rows.join(spots, OPTION, "left")
        .withColumn("priced_legs", priced_legs)
        .withColumn(
            "waypoints",
            F.concat(F.array(point(F.col("origin_lat"), F.col("origin_lon"))), middle, F.array(point(F.col("destination_lat"), F.col("destination_lon")))),
        )
        .withColumn("route_id", pricing.route_fingerprint("origin_lat", "origin_lon", "destination_lat", "destination_lon", F.col("priced_gates")))
        .drop("s")
    )


def option_vs_direct(options: DataFrame, direct: DataFrame) -> DataFrame:
    """Attaches the direct route's time and distance (origin_id, destination_id, direct_s, direct_m)."""
    return options.join(direct, ["origin_id", "destination_id"], "left")
