"""Requests, searches and route options."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.audit_queries import r
from octroi.catalog.cleaning_queries import class_costs
from octroi.catalog.network_queries import access_legs, static_costs
from octroi.catalog.registry import query, view
from octroi.functions import paths, pricing
from octroi.operators import network, options
from octroi.plans import requests as req


def groups(x):
    return req.response_groups(x.requests, class_costs(x.spark))


def edge_costs(x):
    return x.stored("edge_costs", lambda: static_costs(x))


def routes(x):
    return x.stored(
        "routes",
        lambda: req.route_table(groups(x), class_costs(x.spark), access_legs(x), network.moves(edge_costs(x))),
    )


view(
    "asked",
    "SELECT r.request_id, r.origin_id, r.destination_id, r.vehicle_class, CAST(round_even(coalesce(vot, per_hour), 0) AS BIGINT) AS vot_bucket, per_km FROM {requests} r JOIN {class_costs} c ON c.vehicle_class = r.vehicle_class",
)
view("grp", "SELECT DISTINCT origin_id, destination_id, vehicle_class, vot_bucket, per_km FROM {asked}")


@query("vot_bucket", "SELECT request_id, vot_bucket FROM {asked}")
def _(x):
    return req.bucketed(x.requests, class_costs(x.spark)).select("request_id", "vot_bucket")


@query("response_dedupe", "SELECT origin_id, destination_id, vehicle_class, vot_bucket, count(*) AS n_requests FROM {asked} GROUP BY ALL")
def _(x):
    b = req.bucketed(x.requests, class_costs(x.spark))
    return b.groupBy(*req.GROUP).agg(F.count(F.lit(1)).alias("n_requests"))


view("grid", "SELECT i, pow(10.0, log10(1.0) + i * (log10(100.0) - log10(1.0)) / 9.0) AS vot FROM (SELECT unnest(range(0, 10)) AS i)")


@query(
    "log_grid",
    "SELECT DISTINCT vehicle_class, CAST(i AS BIGINT) AS step, round(g.vot, 9) AS vot FROM {requests} q, {grid} g",
)
def _(x):
    c = x.requests.select("vehicle_class").distinct()
    g = c.select("vehicle_class", F.posexplode(pricing.vot_grid()).alias("step", "vot_value"))
    return g.select("vehicle_class", F.col("step").cast("bigint").alias("step"), F.round("vot_value", 9).alias("vot"))


view(
    "srch",
    """SELECT DISTINCT origin_id, vehicle_class, 0::BIGINT AS mode, NULL::DOUBLE AS vot, 0.0::DOUBLE AS k_toll, 0.0::DOUBLE AS k_m, 1.0::DOUBLE AS k_s FROM {grp}
  UNION ALL SELECT DISTINCT origin_id, vehicle_class, CAST(i + 1 AS BIGINT), g.vot, 1.0, per_km / 1000, g.vot / 3600 FROM {grp}, {grid} g
  UNION ALL SELECT DISTINCT origin_id, vehicle_class, vot_bucket + 1000, CAST(vot_bucket AS DOUBLE), 1.0, per_km / 1000, CAST(vot_bucket AS DOUBLE) / 3600 FROM {grp}""",
)
view(
    "mv",
    """SELECT (from_node // 4) * 2 + CASE WHEN from_node % 4 = 3 THEN 1 ELSE 0 END AS node, (to_node // 4) * 2 + CASE WHEN edge_type = 'toll' THEN 1 ELSE 0 END AS to_node,
    (to_node // 4) * 8 + CASE edge_type WHEN 'toll_free' THEN 1 WHEN 'exit_reentry' THEN 2 WHEN 'boundary' THEN 3 ELSE 4 END AS step,
    duration_s + CASE WHEN edge_type = 'boundary' THEN 0 ELSE 180 END AS e_s, distance_m + CASE WHEN edge_type = 'boundary' THEN 0 ELSE 500 END AS e_m, coalesce(class1, 0) AS c1
  FROM {costs} WHERE edge_type <> 'dwell'""",
)
_TOLL = "c1 * CASE s.vehicle_class WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.5466::DOUBLE WHEN 3 THEN 2.4801::DOUBLE WHEN 4 THEN 3.3333::DOUBLE ELSE 0.5849::DOUBLE END"
_KEY = "origin_id, vehicle_class, mode, k_toll, k_m, k_s"
# One row a (search, node). A round reads the rows that the last one improved; equal costs don't replace, so fewer moves stay.
view(
    "st",
    f"""USING KEY origin_id, vehicle_class, mode, node OF {_KEY}, node, v
  SELECT {_KEY}, gare_id * 2 AS node, min(struct_pack(cost := k_toll * 0.0 + k_m * (distance_m + 500) + k_s * (duration_s + 180), h := 0::BIGINT, via := -1::BIGINT, toll := 0.0::DOUBLE, m := distance_m + 500, s := duration_s + 180, p := [gare_id * 8 + 5])) AS v
  FROM {{srch}} JOIN {{acc}} ON hub_id = origin_id AND direction = 'entry' GROUP BY ALL
  UNION ALL
  SELECT c.* FROM (
    SELECT {_KEY}, to_node AS node, min(struct_pack(cost := v.cost + (k_toll * ({_TOLL}) + k_m * e_m + k_s * e_s), h := v.h + 1, via := m.node * 8 + step % 8, toll := v.toll + {_TOLL}, m := v.m + e_m, s := v.s + e_s, p := list_append(v.p, step))) AS v
    FROM sv_st s JOIN {{mv}} m ON m.node = s.node GROUP BY ALL) c
  LEFT JOIN recurring.sv_st o ON o.origin_id = c.origin_id AND o.vehicle_class = c.vehicle_class AND o.mode = c.mode AND o.node = c.node
  WHERE o.v IS NULL OR c.v.cost < o.v.cost""",
)
view(
    "rts",
    f"""SELECT origin_id, vehicle_class, mode, destination_id, struct_pack(cost := (k_toll * q.toll + k_m * q.m) + k_s * q.s, toll := q.toll, m := q.m, s := q.s, h := q.h, p := q.p, last_m := q.last_m) AS r FROM (
  SELECT {_KEY}, hub_id AS destination_id, min(struct_pack(cost := v.cost + ((k_toll * 0.0 + k_m * a.distance_m) + k_s * a.duration_s), node := s.node, toll := v.toll, m := v.m + a.distance_m, s := v.s + a.duration_s, h := v.h, p := v.p, last_m := a.distance_m)) AS q
  FROM {{st}} s JOIN {{acc}} a ON a.direction = 'exit' AND s.node = a.gare_id * 2 + 1 WHERE hub_id <> origin_id GROUP BY ALL)""",
)
view(
    "wanted_rts",
    "SELECT * FROM {rts} t WHERE (t.mode <= 10 AND (origin_id, destination_id, vehicle_class) IN (SELECT (origin_id, destination_id, vehicle_class) FROM {grp})) OR (t.mode > 10 AND (origin_id, destination_id, vehicle_class, mode - 1000) IN (SELECT (origin_id, destination_id, vehicle_class, vot_bucket) FROM {grp}))",
)


@query(
    "shortest_paths",
    """SELECT g.origin_id, g.destination_id, g.vehicle_class, CASE WHEN g.origin_id = g.destination_id THEN 0.0 ELSE round(r.s, 6) END AS duration_s, CASE WHEN g.origin_id = g.destination_id THEN 0.0 ELSE round(r.m, 6) END AS distance_m,
    CASE WHEN g.origin_id = g.destination_id THEN 0.0 ELSE round(r.toll, 6) END AS toll_eur, CASE WHEN g.origin_id <> g.destination_id AND r IS NULL THEN 'no_route' END AS error
  FROM (SELECT DISTINCT origin_id, destination_id, vehicle_class FROM {grp}) g LEFT JOIN {rts} t ON t.origin_id = g.origin_id AND t.destination_id = g.destination_id AND t.vehicle_class = g.vehicle_class AND t.mode = 0""",
)
def _(x):
    asked = groups(x).select(*options.PAIR).distinct()
    fast = routes(x).where(f"mode = {req.FASTEST}").select(*options.PAIR, "duration_s", "distance_m", "toll")
    j = asked.join(fast, options.PAIR, "left")
    return j.select(
        *options.PAIR, r("duration_s", 6), r("distance_m", 6), r("toll", 6, "toll_eur"),
        F.when(F.col("duration_s").isNull(), "no_route").alias("error"),
    )


@query(
    "pareto_sweep",
    "SELECT origin_id, destination_id, vehicle_class, mode, round(r.cost, 6) AS cost, round(r.toll, 6) AS toll_eur, round(r.s, 6) AS duration_s, round(r.m, 6) AS distance_m FROM {wanted_rts} WHERE mode BETWEEN 1 AND 10",
)
def _(x):
    s = routes(x).where("mode BETWEEN 1 AND 10 AND origin_id <> destination_id")
    return s.select(*options.PAIR, "mode", r("cost", 6), r("toll", 6, "toll_eur"), r("duration_s", 6), r("distance_m", 6))
