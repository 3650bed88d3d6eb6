"""Labelled options of routing requests and their details."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.audit_queries import r
from octroi.catalog.cleaning_queries import class_costs, joined
from octroi.catalog.registry import query, view
from octroi.catalog.route_queries import edge_costs, groups, routes
from octroi.functions import paths, pricing
from octroi.operators import options
from octroi.plans import requests as req

PAIR = ", ".join(options.PAIR)
GROUP = ", ".join(req.GROUP)

view(
    "rr",
    """SELECT origin_id, destination_id, vehicle_class, mode, r.toll AS toll, r.m AS m, r.s AS s, r.p AS p, r.last_m AS last_m,
    list_transform(r.p, lambda v: v // 8) AS gs FROM {wanted_rts}
  UNION ALL SELECT DISTINCT g.origin_id, g.destination_id, g.vehicle_class, q.mode, 0.0, 0.0, 0.0, CAST([] AS BIGINT[]), 0.0, CAST([] AS BIGINT[])
  FROM {grp} g JOIN {srch} q ON q.origin_id = g.origin_id AND q.vehicle_class = g.vehicle_class WHERE g.origin_id = g.destination_id""",
)
view("rc", "SELECT *, array_to_string(list_filter(gs, lambda g, i: i = 1 OR g <> gs[i - 1]), ',') AS chain FROM {rr}")
view("fr", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin_id, destination_id, vehicle_class, chain ORDER BY mode) AS rn FROM {rc} WHERE mode BETWEEN 1 AND 10) WHERE rn = 1")
view("ch", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin_id, destination_id, vehicle_class ORDER BY toll, mode) AS k FROM {fr} WHERE toll > 0) WHERE k = 1")
view(
    "pk",
    """SELECT g.origin_id, g.destination_id, g.vehicle_class, g.vot_bucket, f.chain AS f_chain, f.toll AS f_toll, f.m AS f_m, f.s AS f_s, f.p AS f_p, f.last_m AS f_last, b.chain AS b_chain, b.toll AS b_toll, b.m AS b_m, b.s AS b_s, b.p AS b_p, b.last_m AS b_last,
    c.chain AS c_chain, c.toll AS c_toll, c.m AS c_m, c.s AS c_s, c.p AS c_p, c.last_m AS c_last,
    coalesce(c.chain IS NOT NULL AND NOT coalesce(c.last_m / nullif(c.m, 0) > 0.5, FALSE) AND (c.chain = b.chain OR c.chain <> f.chain), FALSE) AS cheap_ok
  FROM {grp} g JOIN {rc} f ON f.origin_id = g.origin_id AND f.destination_id = g.destination_id AND f.vehicle_class = g.vehicle_class AND f.mode = 0
  JOIN {rc} b ON b.origin_id = g.origin_id AND b.destination_id = g.destination_id AND b.vehicle_class = g.vehicle_class AND b.mode = g.vot_bucket + 1000
  LEFT JOIN {ch} c ON c.origin_id = g.origin_id AND c.destination_id = g.destination_id AND c.vehicle_class = g.vehicle_class""",
)
view(
    "ents",
    f"""SELECT {GROUP}, 0 AS rank, 'fastest' AS label, f_chain AS chain, f_toll AS toll, f_m AS m, f_s AS s, f_p AS p, f_last AS last_m, f_toll, f_m, f_s FROM {{pk}}
  UNION ALL SELECT {GROUP}, 1, 'toll_optimised', b_chain, b_toll, b_m, b_s, b_p, b_last, f_toll, f_m, f_s FROM {{pk}}
  UNION ALL SELECT {GROUP}, 2, 'cheapest', c_chain, c_toll, c_m, c_s, c_p, c_last, f_toll, f_m, f_s FROM {{pk}} WHERE cheap_ok
  UNION ALL SELECT k.origin_id, k.destination_id, k.vehicle_class, k.vot_bucket, 3, 'toll_free_route', t.chain, t.toll, t.m, t.s, t.p, t.last_m, f_toll, f_m, f_s
    FROM {{pk}} k JOIN {{fr}} t ON t.origin_id = k.origin_id AND t.destination_id = k.destination_id AND t.vehicle_class = k.vehicle_class AND t.toll = 0
    WHERE t.chain <> f_chain AND t.chain <> b_chain AND NOT (cheap_ok AND t.chain = c_chain) AND ((t.m - f_m) / 1000 >= 10 OR (t.s - f_s) / 60 >= 5)""",
)
view(
    "opts",
    f"""SELECT {GROUP}, chain, string_agg(DISTINCT label, '|' ORDER BY label) AS labels, arg_min(toll, rank) AS toll, arg_min(m, rank) AS m, arg_min(s, rank) AS s, arg_min(p, rank) AS p,
    arg_min(last_m, rank) AS last_m, min(f_toll) AS f_toll, min(f_m) AS f_m, min(f_s) AS f_s,
    min(CASE label WHEN 'fastest' THEN 0 WHEN 'cheapest' THEN 1 WHEN 'toll_optimised' THEN 2 ELSE 3 END) AS label_rank FROM {{ents}} GROUP BY ALL""",
)
view(
    "opt_rows",
    "SELECT *, f_toll - toll AS saving, (s - f_s) / 60 AS extra_min, (m - f_m) / 1000 AS extra_km, CASE WHEN (s - f_s) / 60 > 1e-9 THEN (f_toll - toll) / (((s - f_s) / 60) / 60) WHEN f_toll - toll > 0 THEN CAST('inf' AS DOUBLE) END AS rate FROM {opts}",
)
view(
    "olegs",
    f"""SELECT {GROUP}, chain, i AS pos, p[i - 1] // 8 AS f, p[i] // 8 AS t FROM (SELECT {GROUP}, chain, p, unnest(range(1, len(p) + 1)) AS i FROM {{opts}}) WHERE p[i] % 8 = 4""",
)
_TOLL = "e.class1 * CASE l.vehicle_class WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.5466::DOUBLE WHEN 3 THEN 2.4801::DOUBLE WHEN 4 THEN 3.3333::DOUBLE ELSE 0.5849::DOUBLE END"
view("plegs", f"SELECT l.*, e.operator, {_TOLL} AS price FROM {{olegs}} l JOIN {{costs}} e ON e.from_node = l.f * 4 + 1 AND e.to_node = l.t * 4 + 2")


def chained(x):
    return options.with_chain(routes(x))


def picked(x):
    return options.picks(groups(x), chained(x))


def option_table(x):
    return x.stored("options", lambda: options.option_rows(options.label_options(picked(x))))


def detailed(x):
    return x.stored("option_details", lambda: options.option_details(option_table(x), edge_costs(x), x.gates))


def with_text_chain(df):
    return df.withColumn("chain", joined("chain", ","))


@query("gate_chain", f"SELECT {PAIR}, mode, chain FROM {{rc}}")
def _(x):
    return chained(x).select(*options.PAIR, "mode", joined("chain", ",").alias("chain"))


@query("dedupe_by_chain", f"SELECT {PAIR}, chain, mode, round(toll, 6) AS toll FROM {{fr}}")
def _(x):
    return with_text_chain(options.dedupe_by_chain(chained(x))).select(*options.PAIR, "chain", "mode", r("toll", 6))


@query("max_toll_hops", f"SELECT {PAIR}, mode, CAST(len(list_filter(p, lambda v: v % 8 = 4)) AS BIGINT) AS toll_hops FROM {{rr}} WHERE len(list_filter(p, lambda v: v % 8 = 4)) <= 5")
def _(x):
    t = routes(x).withColumn("toll_hops", paths.toll_hops("path")).where(f"toll_hops <= {options.MAX_TOLL_HOPS}")
    return t.select(*options.PAIR, "mode", F.col("toll_hops").cast("bigint").alias("toll_hops"))


@query("cheapest_guard", f"SELECT {GROUP}, c_chain IS NOT NULL AS has_priced, cheap_ok FROM {{pk}}")
def _(x):
    g = options.cheapest_guard(picked(x))
    return g.select(*req.GROUP, F.col("cheap").isNotNull().alias("has_priced"), "cheap_ok")


@query("label_options", f"SELECT {GROUP}, chain, labels, round(toll, 6) AS toll_eur FROM {{opts}}")
def _(x):
    return option_table(x).select(*req.GROUP, joined("chain", ",").alias("chain"), F.array_join("labels", "|").alias("labels"), r("toll_eur", 6))


@query(
    "option_rows",
    f"SELECT {GROUP}, chain, round(toll, 6) AS toll_eur, round(s, 6) AS duration_s, round(m, 6) AS distance_m, round(saving, 6) AS saving_vs_fastest_eur, round(extra_min, 6) AS extra_minutes, round(extra_km, 6) AS extra_km, round(rate, 4) AS eur_per_hour_saved FROM {{opt_rows}}",
)
def _(x):
    o = option_table(x)
    six = [r(c, 6) for c in ("toll_eur", "duration_s", "distance_m", "saving_vs_fastest_eur", "extra_minutes", "extra_km")]
    rate = F.when(F.col("eur_per_hour_saved") == float("inf"), F.col("eur_per_hour_saved")).otherwise(F.round("eur_per_hour_saved", 4))
    return o.select(*req.GROUP, joined("chain", ",").alias("chain"), *six, rate.alias("eur_per_hour_saved"))


@query(
    "option_order",
    f"SELECT {GROUP}, chain, CAST(row_number() OVER (PARTITION BY {GROUP} ORDER BY label_rank, toll, s, chain) AS BIGINT) AS option_no FROM {{opts}}",
)
def _(x):
    o = options.option_order(with_text_chain(option_table(x)))
    return o.select(*req.GROUP, "chain", F.col("option_no").cast("bigint").alias("option_no"))


@query("detour_floor", f"SELECT {GROUP}, chain, extra_km >= 10 OR extra_min >= 5 AS passes FROM {{opt_rows}}")
def _(x):
    o = option_table(x)
    return o.select(*req.GROUP, joined("chain", ",").alias("chain"), pricing.detour_floor(F.col("extra_km"), F.col("extra_minutes")).alias("passes"))


@query("worthwhile", f"SELECT {GROUP}, chain, coalesce(rate >= vot_bucket, FALSE) AS worthwhile FROM {{opt_rows}}")
def _(x):
    o = option_table(x)
    return o.select(*req.GROUP, joined("chain", ",").alias("chain"), pricing.worthwhile(F.col("eur_per_hour_saved"), F.col("vot_bucket")).alias("worthwhile"))


@query(
    "generalised_cost",
    f"SELECT {GROUP}, chain, round(toll + m / 1000 * per_km + s / 3600 * vot_bucket, 6) AS cost FROM {{opts}} JOIN {{class_costs}} USING (vehicle_class)",
)
def _(x):
    o = option_table(x).join(class_costs(x.spark), "vehicle_class")
    cost = pricing.generalised_cost(F.col("toll_eur"), F.col("distance_m"), F.col("duration_s"), F.col("per_km"), F.col("vot_bucket"))
    return o.select(*req.GROUP, joined("chain", ",").alias("chain"), F.round(cost, 6).alias("cost"))


@query(
    "same_operator_split",
    f"SELECT {GROUP}, chain, coalesce(n > d, FALSE) AS same_operator_split FROM {{opts}} LEFT JOIN (SELECT {GROUP}, chain, count(operator) AS n, count(DISTINCT operator) AS d FROM {{plegs}} GROUP BY ALL) USING ({GROUP}, chain)",
)
def _(x):
    return detailed(x).select(*req.GROUP, joined("chain", ",").alias("chain"), "same_operator_split")


@query(
    "toll_segments",
    f"SELECT {GROUP}, chain, coalesce(segs, '') AS segs FROM {{opts}} LEFT JOIN (SELECT {GROUP}, chain, string_agg(printf('%.6f', price), ',' ORDER BY pos) AS segs FROM {{plegs}} WHERE price > 0 GROUP BY ALL) USING ({GROUP}, chain)",
)
def _(x):
    segs = F.array_join(F.transform("toll_segments", lambda v: F.format_string("%.6f", v)), ",")
    return detailed(x).select(*req.GROUP, joined("chain", ",").alias("chain"), segs.alias("segs"))


@query(
    "toll_gates_detail",
    f"SELECT l.* EXCLUDE (pos, price, operator), a.canonical_name AS from_name, b.canonical_name AS to_name, a.all_routes || '|' || b.all_routes AS roads, round(price, 6) AS price, CAST(row_number() OVER (PARTITION BY {GROUP}, chain ORDER BY pos) AS BIGINT) AS leg_no FROM {{plegs}} l JOIN {{gates}} a ON a.gare_id = f JOIN {{gates}} b ON b.gare_id = t WHERE price > 0",
)
def _(x):
    d = detailed(x).select(*req.GROUP, joined("chain", ",").alias("chain"), F.posexplode("toll_gates_detail").alias("i", "v"))
    return d.select(
        *req.GROUP, "chain", F.col("v.from_gare_id").alias("f"), F.col("v.to_gare_id").alias("t"), "v.from_name", "v.to_name", "v.roads",
        F.round("v.price", 6).alias("price"), (F.col("i") + 1).cast("bigint").alias("leg_no"),
    )


@query(
    "priced_gates",
    f"""SELECT {GROUP}, chain, coalesce(pg, '') AS priced_gates FROM {{opts}} LEFT JOIN (
    SELECT {GROUP}, chain, string_agg(g, ',' ORDER BY k) AS pg FROM (SELECT {GROUP}, chain, g, min(k) AS k FROM (
      SELECT {GROUP}, chain, f AS g, pos * 2 AS k FROM {{plegs}} WHERE price > 0 UNION ALL SELECT {GROUP}, chain, t, pos * 2 + 1 FROM {{plegs}} WHERE price > 0) GROUP BY ALL) GROUP BY ALL) USING ({GROUP}, chain)""",
)
def _(x):
    return detailed(x).select(*req.GROUP, joined("chain", ",").alias("chain"), joined("priced_gates", ",").alias("priced_gates"))


view("leg_ends", f"SELECT {GROUP}, chain, list(t ORDER BY pos) AS ends FROM {{plegs}} WHERE price > 0 GROUP BY ALL")
_FOUND = "list_position(places[a.at + 1 :], e.g)"


@query(
    "toll_leg_indices",
    # each leg's end, looked for behind the place of the one before
    f"""SELECT {GROUP}, chain, array_to_string(list_reduce(list_prepend(struct_pack(at := 0::BIGINT, g := 0::BIGINT, found := []::BIGINT[]),
      list_transform(coalesce(ends, []), lambda x: struct_pack(at := 0::BIGINT, g := x, found := []::BIGINT[]))),
      lambda a, e: CASE WHEN {_FOUND} > 0 THEN struct_pack(at := a.at + {_FOUND}, g := e.g, found := list_append(a.found, a.at + {_FOUND} - 1)) ELSE a END).found, ',') AS indices
    FROM (SELECT {GROUP}, chain, list_transform(list_filter(string_split(chain, ','), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS places FROM {{opts}}) LEFT JOIN {{leg_ends}} USING ({GROUP}, chain)""",
)
def _(x):
    return detailed(x).select(*req.GROUP, joined("chain", ",").alias("chain"), joined("toll_leg_indices", ",").alias("indices"))


view(
    "pgs",
    f"""SELECT {GROUP}, chain, list(g ORDER BY k) AS pg FROM (SELECT {GROUP}, chain, g, min(k) AS k FROM (
      SELECT {GROUP}, chain, f AS g, pos * 2 AS k FROM {{plegs}} WHERE price > 0 UNION ALL SELECT {GROUP}, chain, t, pos * 2 + 1 FROM {{plegs}} WHERE price > 0) GROUP BY ALL) GROUP BY ALL""",
)
view("leg_starts", f"SELECT {GROUP}, chain, list(f) AS starts FROM {{plegs}} WHERE price > 0 GROUP BY ALL")


@query(
    "waypoint_legs",
    f"""SELECT {GROUP}, substr(sha1(printf('%.5f,%.5f|%.5f,%.5f|', a.lat, a.lon, b.lat, b.lon) || array_to_string(coalesce(pg, []), ',')), 1, 16) AS route_id,
      CAST(2 + coalesce(len(pg), 0) AS INTEGER) AS n_waypoints,
      array_to_string(list_sort(list_distinct(list_transform(coalesce(starts, []), lambda f: list_position(pg, f)))), ',') AS priced_legs
    FROM {{opts}} LEFT JOIN {{pgs}} USING ({GROUP}, chain) LEFT JOIN {{leg_starts}} USING ({GROUP}, chain)
    JOIN {{hubs}} a ON a.hub_id = origin_id JOIN {{hubs}} b ON b.hub_id = destination_id""",
)
def _(x):
    w = options.waypoint_legs(detailed(x), x.hubs, x.gates)
    return w.select(*req.GROUP, "route_id", F.size("waypoints").alias("n_waypoints"), joined("priced_legs", ",").alias("priced_legs"))


@query(
    "route_fingerprint",
    f"""SELECT {GROUP}, chain, substr(sha1(printf('%.5f,%.5f|%.5f,%.5f|', a.lat, a.lon, b.lat, b.lon) || chain), 1, 16) AS route_id
  FROM {{opts}} JOIN {{hubs}} a ON a.hub_id = origin_id JOIN {{hubs}} b ON b.hub_id = destination_id""",
)
def _(x):
    o = option_table(x)
    for side in ("origin", "destination"):
        o = o.join(x.hubs.select(F.col("hub_id").alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon")), f"{side}_id")
    rid = pricing.route_fingerprint("origin_lat", "origin_lon", "destination_lat", "destination_lon", F.col("chain"))
    return o.select(*req.GROUP, joined("chain", ",").alias("chain"), rid.alias("route_id"))


view("direct", "SELECT origin_id, destination_id, min(r.s) * 0.9 AS direct_s, min(r.m) * 0.9 AS direct_m FROM {rts} WHERE mode = 0 GROUP BY ALL")


@query(
    "option_vs_direct",
    f"SELECT o.origin_id, o.destination_id, o.vehicle_class, o.vot_bucket, chain, round(direct_s, 6) AS direct_s, round(direct_m, 6) AS direct_m FROM {{opts}} o LEFT JOIN {{direct}} d ON d.origin_id = o.origin_id AND d.destination_id = o.destination_id",
)
def _(x):
    fast = routes(x).where("mode = 0 AND origin_id <> destination_id")
    direct = fast.groupBy("origin_id", "destination_id").agg((F.min("duration_s") * 0.9).alias("direct_s"), (F.min("distance_m") * 0.9).alias("direct_m"))
    o = options.option_vs_direct(option_table(x), direct)
    return o.select(*req.GROUP, joined("chain", ",").alias("chain"), r("direct_s", 6), r("direct_m", 6))


@query(
    "request_results",
    f"SELECT a.request_id, count(o.chain) AS n_options, round(min(o.toll), 6) AS least_toll, CASE WHEN count(o.chain) = 0 THEN 'no_route' END AS error FROM {{asked}} a LEFT JOIN {{opts}} o USING ({GROUP}) GROUP BY a.request_id",
)
def _(x):
    """Every request with the options of its group; a group is shaped once and joined back."""
    per = option_table(x).groupBy(*req.GROUP).agg(F.count(F.lit(1)).alias("n_options"), F.min("toll_eur").alias("least_toll"))
    all_requests = req.bucketed(x.requests, class_costs(x.spark))
    j = all_requests.join(per, req.GROUP, "left")
    return j.select("request_id", F.coalesce("n_options", F.lit(0)).alias("n_options"), r("least_toll", 6), F.when(F.col("n_options").isNull(), "no_route").alias("error"))
