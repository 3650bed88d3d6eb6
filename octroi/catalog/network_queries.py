"""Graph tables, searches inside one operator and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.audit_queries import r
from octroi.catalog.cleaning_queries import suspect_ids
from octroi.catalog.place_queries import transfers
from octroi.catalog.registry import query, view
from octroi.operators import cleaning, network, undercut
from octroi.session import written

view(
    "fares5",
    "SELECT *, class1 * 1.5466::DOUBLE AS class2, class1 * 2.4801::DOUBLE AS class3, class1 * 3.3333::DOUBLE AS class4, class1 * 0.5849::DOUBLE AS class5 FROM {fares}",
)
view("act", "SELECT gare_id, lat, lon FROM {active}")


def active(x):
    return cleaning.active_gates(x.gates, suspect_ids(x))


def fares5(x):
    return cleaning.class_prices(x.fares)


@query("graph_nodes", "SELECT gare_id * 4 + k AS node, gare_id, role FROM {act}, (VALUES (0, 'in'), (1, 'out'), (2, 'in_toll'), (3, 'out_toll')) v(k, role)")
def _(x):
    return network.graph_nodes(active(x))


view("e_dwell", "SELECT gare_id * 4 + k AS from_node, gare_id * 4 + k + 1 AS to_node, 'dwell' AS edge_type, 180.0::DOUBLE AS duration_s, 500.0::DOUBLE AS distance_m, NULL::VARCHAR AS operator, NULL::DOUBLE AS class1, 0::BIGINT AS seq FROM {act}, (VALUES (0), (2)) v(k)")
view(
    "e_self",
    "SELECT from_gare_id * 4 + 1 AS from_node, to_gare_id * 4 + 2 AS to_node, 'toll' AS edge_type, 0.0::DOUBLE AS duration_s, 0.0::DOUBLE AS distance_m, operator, class1, row_id AS seq FROM {fares} WHERE from_gare_id = to_gare_id AND from_gare_id IN (SELECT gare_id FROM {act})",
)
view(
    "e_toll",
    """SELECT from_gare_id * 4 + 1 AS from_node, to_gare_id * 4 + 2 AS to_node, 'toll' AS edge_type,
    CASE WHEN from_pid = to_pid THEN 0.0 WHEN tolled_s IS NULL THEN coalesce(distance_km, 0) * 1000 / (110.0::DOUBLE * 1000 / 3600) ELSE tolled_s END AS duration_s,
    CASE WHEN from_pid = to_pid THEN 0.0 WHEN tolled_s IS NULL THEN coalesce(distance_km, 0) * 1000 ELSE tolled_m END AS distance_m, operator, class1, row_id AS seq
  FROM {fare_legs} WHERE from_gare_id <> to_gare_id AND from_gare_id IN (SELECT gare_id FROM {act}) AND to_gare_id IN (SELECT gare_id FROM {act})
    AND NOT (class1 = 0 AND coalesce(nullif(distance_km, 0), 999) > 8)""",
)
view(
    "free_pairs",
    "SELECT a.gare_id AS from_gare_id, b.gare_id AS to_gare_id, free_s, free_m FROM {legs} m JOIN {points} a ON a.pid = m.from_pid JOIN {points} b ON b.pid = m.to_pid WHERE free_s IS NOT NULL AND a.gare_id IN (SELECT gare_id FROM {act}) AND b.gare_id IN (SELECT gare_id FROM {act})",
)
view(
    "e_free",
    "SELECT from_gare_id * 4 + k AS from_node, to_gare_id * 4 AS to_node, 'toll_free' AS edge_type, free_s AS duration_s, free_m AS distance_m, NULL::VARCHAR AS operator, NULL::DOUBLE AS class1, 0::BIGINT AS seq FROM {free_pairs}, (VALUES (1), (3)) v(k)",
)
view(
    "e_transfer",
    """SELECT p * 4 + k AS from_node, q * 4 + CASE WHEN boundary THEN 1 ELSE 0 END AS to_node, CASE WHEN boundary THEN 'boundary' ELSE 'exit_reentry' END AS edge_type,
    CASE WHEN boundary THEN 0.0::DOUBLE ELSE 180.0::DOUBLE END AS duration_s, CASE WHEN boundary THEN 0.0::DOUBLE ELSE 500.0::DOUBLE END AS distance_m, NULL::VARCHAR AS operator, NULL::DOUBLE AS class1, 0::BIGINT AS seq
  FROM (SELECT a_id AS p, b_id AS q, boundary FROM {transfers} UNION ALL SELECT b_id, a_id, boundary FROM {transfers}), (VALUES (1), (3)) v(k)
  WHERE p IN (SELECT gare_id FROM {act}) AND q IN (SELECT gare_id FROM {act})""",
)
view("all_edges", "SELECT * FROM {e_dwell} UNION ALL SELECT * FROM {e_self} UNION ALL SELECT * FROM {e_toll} UNION ALL SELECT * FROM {e_free} UNION ALL SELECT * FROM {e_transfer}")

_COLS = ["from_node", "to_node", "edge_type", "duration_s", "distance_m"]
_SQL = "from_node, to_node, edge_type, round(duration_s, 6) AS duration_s, round(distance_m, 6) AS distance_m"


def _shown(e, *more):
    return e.select("from_node", "to_node", "edge_type", r("duration_s", 6), r("distance_m", 6), *more)


def static_edges(x):
    return network.static_edges(x.gates, fares5(x), active(x), x.points, x.legs, transfers(x))


def static_costs(x):
    return network.static_costs(fares5(x), active(x), x.points, x.legs, transfers(x))


@query("edges_dwell", f"SELECT {_SQL} FROM {{e_dwell}}")
def _(x):
    return _shown(network.edges_dwell(active(x)))


@query("edges_selfloop", f"SELECT {_SQL}, operator, class1 FROM {{e_self}}")
def _(x):
    return _shown(network.edges_selfloop(fares5(x), active(x)), "operator", "class1")


@query("edges_toll", f"SELECT {_SQL}, operator, class1, seq FROM {{e_toll}}")
def _(x):
    return _shown(network.edges_toll(fares5(x), active(x), x.points, x.legs), "operator", "class1", "seq")


@query("dense_pairs", "SELECT * FROM {free_pairs}")
def _(x):
    return network.dense_pairs(active(x), x.points, x.legs)


@query("edges_free", f"SELECT {_SQL} FROM {{e_free}}")
def _(x):
    return _shown(network.edges_free(active(x), x.points, x.legs))


@query("edges_transfer", f"SELECT {_SQL} FROM {{e_transfer}}")
def _(x):
    return _shown(network.edges_transfer(transfers(x), active(x)))


view(
    "acc",
    """SELECT hub_id, a.gare_id, a.direction, duration_s + coalesce(apron_duration_s, 0) AS duration_s, distance_m + coalesce(apron_distance_m, 0) AS distance_m
  FROM {access} a LEFT JOIN {anchors} n ON n.gare_id = a.gare_id AND n.direction = a.direction WHERE duration_s IS NOT NULL AND a.gare_id IN (SELECT gare_id FROM {act})""",
)


def access_legs(x):
    return network.access_legs(x.access, x.anchors, active(x))


@query("access_leg_join", "SELECT hub_id, gare_id, direction, round(duration_s, 6) AS duration_s, round(distance_m, 6) AS distance_m FROM {acc}")
def _(x):
    return access_legs(x).select("hub_id", "gare_id", "direction", r("duration_s", 6), r("distance_m", 6))


@query(
    "edges_access",
    "SELECT CASE WHEN direction = 'entry' THEN -2 * hub_id - 1 ELSE gare_id * 4 + 3 END AS from_node, CASE WHEN direction = 'entry' THEN gare_id * 4 ELSE -2 * hub_id - 2 END AS to_node, 'access' AS edge_type, round(duration_s, 6) AS duration_s, round(distance_m, 6) AS distance_m FROM {acc}",
)
def _(x):
    return _shown(network.edges_access(access_legs(x)))


@query("edge_union", f"SELECT {_SQL} FROM {{all_edges}}")
def _(x):
    return _shown(static_edges(x))


@query("graph_stats", "SELECT edge_type, count(*) AS n_edges FROM {all_edges} GROUP BY edge_type")
def _(x):
    return network.graph_stats(static_edges(x))


@query(
    "chaining_invariant",
    """SELECT 'toll_dwell_toll' AS rule, (SELECT count(*) FROM {e_dwell} WHERE from_node IN (SELECT to_node FROM {all_edges} WHERE edge_type = 'toll') AND to_node IN (SELECT from_node FROM {all_edges} WHERE edge_type = 'toll')) AS n
  UNION ALL SELECT 'toll_lands_elsewhere', (SELECT count(*) FROM {all_edges} WHERE edge_type = 'toll' AND (to_node % 4 <> 2 OR from_node % 4 <> 1))
  UNION ALL SELECT 'free_lands_elsewhere', (SELECT count(*) FROM {all_edges} WHERE edge_type IN ('toll_free', 'exit_reentry') AND to_node % 4 <> 0)
  UNION ALL SELECT 'boundary_lands_elsewhere', (SELECT count(*) FROM {all_edges} WHERE edge_type = 'boundary' AND to_node % 4 <> 1)""",
)
def _(x):
    return network.chaining_violations(static_edges(x))


view(
    "costs",
    """SELECT from_node, to_node, edge_type, duration_s, distance_m, class1, operator FROM (
    SELECT *, row_number() OVER (PARTITION BY from_node, to_node ORDER BY CASE edge_type WHEN 'dwell' THEN 0 WHEN 'toll' THEN 1 WHEN 'toll_free' THEN 2 WHEN 'boundary' THEN 3 ELSE 4 END DESC, seq DESC) AS rn FROM {all_edges}) WHERE rn = 1""",
)


@query("edge_costs", "SELECT from_node, to_node, edge_type, round(distance_m / 1000, 6) AS km, round(duration_s / 3600, 6) AS hours, class1 FROM {costs}")
def _(x):
    c = static_costs(x)
    return c.select("from_node", "to_node", "edge_type", r("km", 6), r("hours", 6), "class1")


# --- chains inside one operator ----------------------------------------------------------------

view(
    "pp",
    "SELECT operator, from_gare_id AS f, to_gare_id AS t, arg_max(class1, row_id) AS direct, min(class1) AS w FROM {fares} WHERE class1 <> 0 AND from_gare_id <> to_gare_id GROUP BY ALL",
)
# One row a (source, gate); a round reads what the last one improved, and equal prices don't replace, so shorter chains stay.
view(
    "op_chains",
    """USING KEY operator, f, t OF operator, f, t, v
  SELECT operator, f, t, struct_pack(price := w, h := 1::BIGINT, last := f, via := []::BIGINT[]) AS v FROM {pp}
  UNION ALL
  SELECT c.* FROM (
    SELECT c.operator, c.f, p.t, min(struct_pack(price := v.price + p.w, h := v.h + 1, last := p.f, via := list_append(v.via, p.f))) AS v
    FROM sv_op_chains c JOIN {pp} p ON p.operator = c.operator AND p.f = c.t WHERE p.t <> c.f GROUP BY ALL) c
  LEFT JOIN recurring.sv_op_chains o ON o.operator = c.operator AND o.f = c.f AND o.t = c.t
  WHERE o.v IS NULL OR c.v.price < o.v.price""",
)


@query("min_plus_closure", "SELECT operator, f AS source, t AS target, round(v.price, 6) AS price FROM {op_chains}")
def _(x):
    c, _ = undercut.min_plus_closure(written(undercut.priced_pairs(x.fares), "priced-pairs"))
    return c.select("operator", "source", "target", r("price", 6))


view(
    "under",
    "SELECT *, price < direct - greatest(0.05, direct * 0.5 / 100) AS undercut FROM (SELECT p.operator, p.f, p.t, p.direct, c.v.price AS price, c.v.h AS h, c.v.via AS via FROM {pp} p JOIN {op_chains} c ON c.operator = p.operator AND c.f = p.f AND c.t = p.t)",
)


@query(
    "undercut_audit",
    "SELECT operator, f AS from_gare_id, t AS to_gare_id, direct, round(price, 6) AS chain_price, undercut, round(CASE WHEN undercut THEN (direct - price) / direct * 100 ELSE 0 END, 6) AS undercut_pct, CASE WHEN undercut THEN h END AS path_hops, CASE WHEN undercut THEN array_to_string(via, ',') END AS via FROM {under}",
)
def _(x):
    a = undercut.undercut_audit(x.fares)
    return a.select("operator", "from_gare_id", "to_gare_id", "direct", r("chain_price", 6), "undercut", r("undercut_pct", 6), F.col("path_hops").cast("bigint").alias("path_hops"), F.array_join(F.col("via").cast("array<string>"), ",").alias("via"))


@query("undercut_summary", "SELECT operator, count(*) AS n_pairs, count(*) FILTER (undercut) AS n_undercut FROM {under} GROUP BY operator")
def _(x):
    return undercut.undercut_summary(undercut.undercut_judged(x.fares))


view("worst", "SELECT * FROM (SELECT *, (direct - price) / direct * 100 AS pct, row_number() OVER (PARTITION BY operator ORDER BY (direct - price) / direct * 100 DESC, f, t) AS rn FROM {under} WHERE undercut) WHERE rn <= 3 ORDER BY pct DESC, operator, f, t LIMIT 13")


@query(
    "undercut_sample",
    """SELECT operator, f AS from_gare_id, t AS to_gare_id, direct, undercut FROM {worst}
  UNION ALL SELECT operator, f, t, direct, undercut FROM (SELECT *, row_number() OVER (ORDER BY direct DESC, operator, f, t) AS k FROM {under} WHERE NOT undercut) WHERE k <= 16 - (SELECT count(*) FROM {worst})""",
)
def _(x):
    s = undercut.undercut_sample(undercut.undercut_judged(x.fares))
    return s.select("operator", "from_gare_id", "to_gare_id", "direct", "undercut")
