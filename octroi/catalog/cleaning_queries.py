"""Filters, rule chains, endpoint resolution and name handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.registry import flag_cases, hav, norm_name, pipe_list, query, tokens, view
from octroi.functions import text
from octroi.operators import cleaning, resolve
from octroi.sources.standins import Inputs

view("suspects", "SELECT gare_id, 'snap_distance_over_200m' AS reason FROM {gates} WHERE snap_distance_m > 200")
view("active", "SELECT * FROM {gates} WHERE lat IS NOT NULL AND gare_id NOT IN (SELECT gare_id FROM {suspects})")


def suspects(x: Inputs):
    return cleaning.snap_suspects(x.gates, x.fares)


def suspect_ids(x: Inputs):
    return x.gates.where(F.col("snap_distance_m") > cleaning.SNAP_LIMIT_M).select(
        "gare_id", F.lit("snap_distance_over_200m").alias("reason")
    )


def joined(c, sep="|"):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), sep)


@query(
    "split_pipe_set",
    f"SELECT gare_id, array_to_string({pipe_list('operators')}, '|') AS ops, len({pipe_list('all_names')}) AS n_names FROM {{gates}}",
)
def _(x):
    return x.gates.select(
        "gare_id", F.array_join(text.pipe_set("operators"), "|").alias("ops"),
        F.size(text.pipe_set("all_names")).cast("bigint").alias("n_names"),
    )


@query("route_tokens", f"SELECT gare_id, array_to_string({tokens('all_routes')}, '|') AS roads FROM {{gates}}")
def _(x):
    return x.gates.select("gare_id", F.array_join(text.route_tokens("all_routes"), "|").alias("roads"))


view(
    "op_names",
    f"SELECT DISTINCT raw_name FROM (SELECT operator AS raw_name FROM {{fares}} UNION ALL SELECT unnest({pipe_list('operators')}) FROM {{gates}})",
)


@query("distinct_operators", "SELECT raw_name FROM {op_names}")
def _(x):
    return cleaning.distinct_operators(x.fares, x.gates)


@query(
    "canonical_operator",
    "SELECT raw_name, CASE WHEN raw_name = 'Seg_automobile' THEN 'CARS' ELSE upper(raw_name) END AS canonical_operator FROM (SELECT raw_name FROM {op_names} UNION SELECT 'Seg_' || lower(c_mktsegment) FROM customer)",
)
def _(x):
    names = cleaning.distinct_operators(x.fares, x.gates).union(
        x.table("customer").select(F.concat(F.lit("Seg_"), F.lower("c_mktsegment")))
    )
    aliases = x.spark.createDataFrame([("Seg_automobile", "CARS")], "raw_name string, alias string")
    return cleaning.canonical_operators(names.distinct(), aliases)


@query("normalise_name", f"SELECT gare_id, {norm_name('canonical_name')} AS name FROM {{gates}}")
def _(x):
    return x.gates.select("gare_id", text.normalise_name("canonical_name").alias("name"))


@query("zero_price_rows", "SELECT row_id, operator, from_gare_id, to_gare_id FROM {fares} WHERE class1 = 0")
def _(x):
    return cleaning.zero_price_rows(x.fares).select("row_id", "operator", "from_gare_id", "to_gare_id")


@query("active_gates", "SELECT gare_id, lat, lon FROM {active}")
def _(x):
    return cleaning.active_gates(x.gates, suspect_ids(x)).select("gare_id", "lat", "lon")


view("flagged_fares", "SELECT *, row_id % 7 = 0 AS quarantined FROM {fares}")


def flagged_fares(x):
    return x.fares.withColumn("quarantined", F.col("row_id") % 7 == 0)


@query(
    "usable_fares",
    "SELECT row_id, class1 FROM {flagged_fares} WHERE from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL AND NOT quarantined",
)
def _(x):
    return cleaning.usable_fares(flagged_fares(x)).select("row_id", "class1")


view(
    "far_ends",
    "SELECT row_id, CASE WHEN row_id % 211 = 0 THEN from_gare_id + 1000000000 ELSE from_gare_id END AS from_gare_id, to_gare_id, operator FROM {fares}",
)


def far_ends(x):
    """Fares some of which name a gate that does not exist."""
    return x.fares.withColumn(
        "from_gare_id",
        F.when(F.col("row_id") % 211 == 0, F.col("from_gare_id") + 1_000_000_000).otherwise(F.col("from_gare_id")),
    )


@query(
    "fare_skip_reason",
    """SELECT reason, count(*) AS n_rows FROM (
      SELECT CASE WHEN (a.gare_id IS NOT NULL AND a.lat IS NULL) OR (b.gare_id IS NOT NULL AND b.lat IS NULL) THEN 'no_coordinates'
        WHEN sa.gare_id IS NOT NULL OR sb.gare_id IS NOT NULL THEN 'suspect'
        WHEN a.gare_id IS NULL OR b.gare_id IS NULL THEN 'unclustered' END AS reason
      FROM {far_ends} f LEFT JOIN {gates} a ON a.gare_id = f.from_gare_id LEFT JOIN {gates} b ON b.gare_id = f.to_gare_id
      LEFT JOIN {suspects} sa ON sa.gare_id = f.from_gare_id LEFT JOIN {suspects} sb ON sb.gare_id = f.to_gare_id
      WHERE f.from_gare_id IS NOT NULL AND f.to_gare_id IS NOT NULL) WHERE reason IS NOT NULL GROUP BY reason""",
)
def _(x):
    return (
        cleaning.fare_skip_reason(far_ends(x), x.gates, suspect_ids(x)).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "long_zero_drop",
    "SELECT row_id FROM {fares} WHERE from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL AND NOT (class1 = 0 AND from_gare_id <> to_gare_id AND coalesce(nullif(distance_km, 0), 999) > 8)",
)
def _(x):
    known = cleaning.class_prices(x.fares)
    return cleaning.long_zero_drop(cleaning.usable_fares(known)).select("row_id")


view(
    "refs",
    "SELECT g AS gare_id, count(*) AS affected FROM (SELECT from_gare_id AS g FROM {fares} UNION ALL SELECT to_gare_id FROM {fares} WHERE to_gare_id IS DISTINCT FROM from_gare_id) WHERE g IS NOT NULL GROUP BY g",
)


@query(
    "coordinateless_gates",
    "SELECT g.gare_id, canonical_name, all_routes, operators, coalesce(affected, 0) AS affected FROM {gates} g LEFT JOIN {refs} r ON r.gare_id = g.gare_id WHERE lat IS NULL",
)
def _(x):
    return cleaning.coordinateless_gates(x.gates, x.fares)


@query(
    "snap_suspects",
    "SELECT g.gare_id, canonical_name, 'snap_distance_over_200m' AS reason, coalesce(affected, 0) AS affected, printf('snap_distance_m=%.1f', snap_distance_m) AS detail FROM {gates} g LEFT JOIN {refs} r ON r.gare_id = g.gare_id WHERE snap_distance_m > 200",
)
def _(x):
    return suspects(x)


@query(
    "name_flags",
    f"SELECT gare_id, coalesce(array_to_string(list_filter([{flag_cases()}], lambda s: s IS NOT NULL), '|'), '') AS flags FROM {{gates}}",
)
def _(x):
    return x.gates.select("gare_id", F.array_join(cleaning.name_flags(F.col("canonical_name")), "|").alias("flags"))


_CONF = "[CASE WHEN match_tier IN ('D', 'E', 'F') THEN 'LOW_CONFIDENCE' END, CASE WHEN match_tier = 'O' THEN 'MANUAL_OVERRIDE' END, CASE WHEN match_agreement = 'conflicted' THEN 'CONFLICTED' END]"


@query(
    "confidence_flags",
    f"SELECT gare_id, coalesce(array_to_string(list_filter({_CONF}, lambda s: s IS NOT NULL), '|'), '') AS flags FROM {{gates}}",
)
def _(x):
    return x.gates.select(
        "gare_id", F.array_join(cleaning.confidence_flags(F.col("match_tier"), F.col("match_agreement")), "|").alias("flags")
    )


view(
    "tickets",
    """SELECT CAST(o_orderkey AS BIGINT) AS request_id, CAST(o_orderkey % 7 AS INT) AS vehicle_class,
  CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE 45.0 END AS origin_lat, CASE WHEN o_orderkey % 11 IN (1, 6) THEN NULL ELSE 4.0 END AS origin_lon,
  CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 13 = 4 THEN 'somewhere' END AS origin_address,
  CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE 46.0 END AS destination_lat, CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE 5.0 END AS destination_lon,
  CASE WHEN o_orderkey % 34 = 3 THEN 'there' END AS destination_address FROM {orders}""",
)


@query(
    "validate_requests",
    """SELECT request_id, CASE WHEN NOT coalesce(vehicle_class BETWEEN 1 AND 5, FALSE) THEN 'vehicle_class must be 1-5'
    WHEN (origin_lat IS NULL) <> (origin_lon IS NULL) THEN 'origin: provide both coordinates or neither'
    WHEN origin_lat IS NOT NULL AND origin_address IS NOT NULL THEN 'origin: provide coordinates or an address, not both'
    WHEN origin_lat IS NULL AND origin_address IS NULL THEN 'origin: provide coordinates or an address'
    WHEN (destination_lat IS NULL) <> (destination_lon IS NULL) THEN 'destination: provide both coordinates or neither'
    WHEN destination_lat IS NOT NULL AND destination_address IS NOT NULL THEN 'destination: provide coordinates or an address, not both'
    WHEN destination_lat IS NULL AND destination_address IS NULL THEN 'destination: provide coordinates or an address' END AS error FROM {tickets}""",
)
def _(x):
    from octroi.catalog.registry import VIEWS

    tickets = x.spark.sql(VIEWS["tickets"], orders=x.table("orders"))
    return cleaning.validate_requests(tickets).select("request_id", "error")


view(
    "class_costs",
    "SELECT * FROM (VALUES (1, 0.15::DOUBLE, 12.0::DOUBLE), (2, 0.20, 15.0), (3, 0.25, 30.0), (4, 0.30, 50.0), (5, 0.10, 10.0)) t(vehicle_class, per_km, per_hour)",
)


def class_costs(spark):
    from octroi.functions.pricing import CLASS_DEFAULTS

    rows = [(k, a, b) for k, (a, b) in CLASS_DEFAULTS.items()]
    return spark.createDataFrame(rows, "vehicle_class int, per_km double, per_hour double")


@query(
    "class_config_load",
    "SELECT request_id, r.vehicle_class, per_km, coalesce(vot, per_hour) AS vot FROM {requests} r JOIN {class_costs} c ON c.vehicle_class = r.vehicle_class",
)
def _(x):
    return cleaning.request_classes(x.requests, class_costs(x.spark)).select(
        "request_id", "vehicle_class", "per_km", F.coalesce("vot", "per_hour").alias("vot")
    )


view(
    "snap_pairs",
    """SELECT gare_id, CASE WHEN gare_id % 13 = 5 THEN NULL ELSE CAST(gare_id * 37 % 400 AS DOUBLE) END AS free_dist_m,
  CASE WHEN gare_id % 5 = 2 THEN 'track' ELSE 'road' END AS free_use, CAST(gare_id * 7 % 90 AS INT) AS free_speed,
  CASE WHEN gare_id % 17 = 4 THEN NULL ELSE CAST(gare_id * 11 % 120 AS DOUBLE) END AS full_dist_m FROM {gates} WHERE lat IS NOT NULL""",
)


def snap_pairs(x):
    from octroi.catalog.registry import VIEWS

    return x.spark.sql(VIEWS["snap_pairs"], gates=x.gates)


view(
    "needed",
    """SELECT gare_id, CASE WHEN free_dist_m IS NULL THEN TRUE WHEN free_dist_m <= 50 THEN free_use = 'track' OR free_speed < 30
  WHEN full_dist_m IS NULL THEN FALSE ELSE free_dist_m > 3 * full_dist_m END AS anchor_needed FROM {snap_pairs}""",
)


@query("anchor_needed", "SELECT gare_id, anchor_needed FROM {needed}")
def _(x):
    return cleaning.anchor_needed(snap_pairs(x)).select("gare_id", "anchor_needed")


# --- joins and rule chains ---------------------------------------------------------------------


@query(
    "fare_endpoints",
    """SELECT row_id, a.canonical_name AS from_canonical_name, a.lat AS from_lat, b.canonical_name AS to_canonical_name, b.lat AS to_lat
  FROM {fares} f LEFT JOIN {gates} a ON a.gare_id = f.from_gare_id LEFT JOIN {gates} b ON b.gare_id = f.to_gare_id""",
)
def _(x):
    return cleaning.fare_endpoints(x.fares, x.gates, ["canonical_name", "lat"]).select(
        "row_id", "from_canonical_name", "from_lat", "to_canonical_name", "to_lat"
    )


view(
    "zero_classified",
    f"""SELECT row_id, operator, from_gare_id, to_gare_id, km, rule,
    CASE rule WHEN 'operator_boundary_short_hop' THEN 'free_transfer' WHEN 'default_no_signal' THEN 'drop' ELSE 'free_section' END AS disposition
  FROM (SELECT *, CASE WHEN coalesce(km <= 8, FALSE) AND oa IS NOT NULL AND ob IS NOT NULL AND oa <> ob THEN 'operator_boundary_short_hop'
      WHEN lower(from_gare) LIKE '%bifurcation%' OR lower(to_gare) LIKE '%bifurcation%' THEN 'structural_node_name'
      WHEN coalesce(km <= 8, FALSE) THEN 'short_physical_hop' ELSE 'default_no_signal' END AS rule
    FROM (SELECT f.*, CASE WHEN a.gare_id IS NOT NULL THEN array_to_string({pipe_list('a.operators')}, '|') END AS oa,
        CASE WHEN b.gare_id IS NOT NULL THEN array_to_string({pipe_list('b.operators')}, '|') END AS ob,
        coalesce({hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371.0)}, distance_km) AS km
      FROM {{fares}} f LEFT JOIN {{gates}} a ON a.gare_id = f.from_gare_id LEFT JOIN {{gates}} b ON b.gare_id = f.to_gare_id WHERE class1 = 0))""",
)


@query("zero_price_disposition", "SELECT row_id, operator, round(km, 3) AS km, disposition, rule FROM {zero_classified}")
def _(x):
    return cleaning.zero_price_disposition(x.fares, x.gates).select(
        "row_id", "operator", F.round("km", 3).alias("km"), "disposition", "rule"
    )


@query("apply_zero_price", "SELECT row_id, class1 FROM {fares} WHERE row_id NOT IN (SELECT row_id FROM {zero_classified} WHERE disposition = 'drop')")
def _(x):
    return cleaning.apply_zero_price(x.fares, x.gates).select("row_id", "class1")


@query(
    "disposition_tally",
    """SELECT coalesce(operator, '(all)') AS operator, count(*) FILTER (disposition = 'drop') AS n_drop,
    count(*) FILTER (disposition = 'free_section') AS n_free_section, count(*) FILTER (disposition = 'free_transfer') AS n_free_transfer,
    count(*) AS n_rows FROM {zero_classified} GROUP BY ROLLUP (operator)""",
)
def _(x):
    return cleaning.disposition_tally(cleaning.zero_price_disposition(x.fares, x.gates))


@query(
    "open_system_remap",
    """SELECT row_id, CASE WHEN tr THEN to_gare_id ELSE from_gare_id END AS from_gare_id, CASE WHEN fr THEN from_gare_id ELSE to_gare_id END AS to_gare_id,
    CASE WHEN tr THEN to_gare ELSE from_gare END AS from_gare, CASE WHEN fr THEN from_gare ELSE to_gare END AS to_gare, tr OR fr AS remapped
  FROM (SELECT *, known AND pf AND NOT pt AS tr, known AND pt AND NOT pf AS fr FROM (
    SELECT *, from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL AS known, coalesce(from_gare_id % 50 = 0, FALSE) AS pf, coalesce(to_gare_id % 50 = 0, FALSE) AS pt FROM {fares}))""",
)
def _(x):
    pseudo = x.gates.where(text.lower_bare("canonical_name").contains("systeme ouvert"))
    return cleaning.open_system_remap(x.fares, pseudo).select(
        "row_id", "from_gare_id", "to_gare_id", "from_gare", "to_gare", "remapped"
    )


# --- blank endpoints ---------------------------------------------------------------------------

view("gate_keys", f"SELECT gare_id, {norm_name('canonical_name')} AS name FROM {{gates}}")
view("alias_keys", f"SELECT DISTINCT gare_id, {norm_name('a')} AS name FROM (SELECT gare_id, unnest({pipe_list('all_names')}) AS a FROM {{gates}})")
view(
    "blanks",
    f"""SELECT row_id, 'to' AS endpoint, operator, to_gare AS raw_name, {norm_name('to_gare')} AS name, from_gare_id AS known_gare_id, distance_km, class1 FROM {{fares}} WHERE to_gare_id IS NULL
  UNION ALL SELECT row_id, 'from', operator, from_gare, {norm_name('from_gare')}, to_gare_id, distance_km, class1 FROM {{fares}} WHERE from_gare_id IS NULL""",
)
view("m_canonical", "SELECT row_id, endpoint, min(k.gare_id) AS matched_gare_id FROM {blanks} b JOIN {gate_keys} k ON k.name = b.name GROUP BY row_id, endpoint HAVING count(*) = 1")
view(
    "m_alias",
    "SELECT row_id, endpoint, min(k.gare_id) AS matched_gare_id FROM {blanks} b JOIN {alias_keys} k ON k.name = b.name WHERE b.name NOT IN (SELECT name FROM {gate_keys}) GROUP BY row_id, endpoint HAVING count(*) = 1",
)
view("cands", "SELECT row_id, endpoint, k.gare_id FROM {blanks} b JOIN (SELECT name, gare_id FROM {gate_keys} UNION SELECT name, gare_id FROM {alias_keys}) k ON k.name = b.name")
view(
    "m_near",
    f"""SELECT row_id, endpoint, gare_id AS matched_gare_id FROM (
    SELECT *, row_number() OVER w AS r, lead(err) OVER w AS second_err FROM (
      SELECT b.row_id, b.endpoint, c.gare_id, b.distance_km, abs({hav('k.lat', 'k.lon', 'g.lat', 'g.lon', 6371.0)} - b.distance_km) AS err
      FROM {{blanks}} b JOIN {{cands}} c USING (row_id, endpoint) JOIN {{gates}} k ON k.gare_id = b.known_gare_id JOIN {{gates}} g ON g.gare_id = c.gare_id
      WHERE b.distance_km IS NOT NULL AND k.lat IS NOT NULL AND g.lat IS NOT NULL)
    WINDOW w AS (PARTITION BY row_id, endpoint ORDER BY err, gare_id))
  WHERE r = 1 AND second_err IS NOT NULL AND err <= greatest(5.0, distance_km * 0.25) AND second_err - err > greatest(5.0, distance_km * 0.25)""",
)
view(
    "m_tag",
    f"""SELECT row_id, endpoint, min(gare_id) FILTER (tagged) AS matched_gare_id FROM (
    SELECT c.*, list_contains({pipe_list('g.operators')}, b.operator) AS tagged FROM {{cands}} c JOIN {{blanks}} b USING (row_id, endpoint) JOIN {{gates}} g ON g.gare_id = c.gare_id)
  GROUP BY row_id, endpoint HAVING count(*) >= 2 AND count(*) FILTER (tagged) = 1""",
)
view(
    "resolved",
    """SELECT b.*, coalesce(m1.matched_gare_id, m2.matched_gare_id, m3.matched_gare_id, m4.matched_gare_id) AS matched_gare_id,
    CASE WHEN m1.matched_gare_id IS NOT NULL THEN 'canonical_name_exact_match' WHEN m2.matched_gare_id IS NOT NULL THEN 'alias_name_match'
      WHEN m3.matched_gare_id IS NOT NULL THEN 'coordinate_proximity_disambiguation' WHEN m4.matched_gare_id IS NOT NULL THEN 'operator_tag_disambiguation'
      ELSE 'default_unresolved' END AS rule
  FROM {blanks} b LEFT JOIN {m_canonical} m1 USING (row_id, endpoint) LEFT JOIN {m_alias} m2 USING (row_id, endpoint)
  LEFT JOIN {m_near} m3 USING (row_id, endpoint) LEFT JOIN {m_tag} m4 USING (row_id, endpoint)""",
)


def _ends(x):
    return resolve.blank_endpoints(x.fares)


@query("match_canonical", "SELECT * FROM {m_canonical}")
def _(x):
    return resolve.match_canonical(_ends(x), x.gates)


@query("match_alias", "SELECT * FROM {m_alias}")
def _(x):
    return resolve.match_alias(_ends(x), x.gates)


@query("match_candidates", "SELECT row_id, endpoint, count(*) AS n_candidates, min(gare_id) AS first_id FROM {cands} GROUP BY row_id, endpoint")
def _(x):
    """Candidates per endpoint; counted per name first, so no name is paired with all its endpoints."""
    per_name = resolve.name_candidates(x.gates).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min("gare_id").alias("first_id")
    )
    return _ends(x).join(per_name, "name").select("row_id", "endpoint", "n_candidates", "first_id")


@query(
    "candidate_union",
    f"SELECT name, gare_id FROM {{gate_keys}} UNION SELECT name, gare_id FROM {{alias_keys}}",
)
def _(x):
    return resolve.name_candidates(x.gates)


@query("match_proximity", "SELECT * FROM {m_near}")
def _(x):
    return resolve.match_proximity(_ends(x), x.gates)


@query("match_operator_tag", "SELECT * FROM {m_tag}")
def _(x):
    return resolve.match_operator_tag(_ends(x), x.gates)


@query("resolve_blank_endpoints", "SELECT row_id, endpoint, rule, CASE WHEN matched_gare_id IS NULL THEN 'drop' ELSE 'matched' END AS disposition, matched_gare_id FROM {resolved}")
def _(x):
    return resolve.resolve_blank_endpoints(x.fares, x.gates).select(
        "row_id", "endpoint", "rule", "disposition", "matched_gare_id"
    )


view(
    "rematched",
    """SELECT f.* EXCLUDE (from_gare_id, to_gare_id), coalesce(f.from_gare_id, a.matched_gare_id) AS from_gare_id, coalesce(f.to_gare_id, b.matched_gare_id) AS to_gare_id
  FROM {fares} f LEFT JOIN {resolved} a ON a.row_id = f.row_id AND a.endpoint = 'from' LEFT JOIN {resolved} b ON b.row_id = f.row_id AND b.endpoint = 'to'""",
)


def rematched(x):
    return resolve.apply_rematch(x.fares, resolve.resolve_blank_endpoints(x.fares, x.gates))


@query("apply_rematch", "SELECT row_id, from_gare_id, to_gare_id FROM {rematched}")
def _(x):
    return rematched(x).select("row_id", "from_gare_id", "to_gare_id")


@query(
    "rate_stats",
    """SELECT count(*) AS n_rows, round(min(class1 / distance_km * 100), 6) AS min_cents, round(max(class1 / distance_km * 100), 6) AS max_cents,
    round(avg(class1 / distance_km * 100), 6) AS mean_cents FROM {resolved} WHERE matched_gare_id IS NOT NULL AND class1 <> 0 AND distance_km <> 0""",
)
def _(x):
    s = resolve.rate_stats(resolve.resolve_blank_endpoints(x.fares, x.gates))
    return s.select("n_rows", *[F.round(c, 6).alias(c) for c in ("min_cents", "max_cents", "mean_cents")])


@query(
    "rematch_tally",
    """SELECT coalesce(operator, '(all)') AS operator, count(*) FILTER (matched_gare_id IS NOT NULL) AS n_matched, count(*) FILTER (matched_gare_id IS NULL) AS n_drop
    FROM {resolved} GROUP BY ROLLUP (operator)""",
)
def _(x):
    r = resolve.resolve_blank_endpoints(x.fares, x.gates)
    return (
        r.rollup("operator")
        .agg(F.count_if(F.col("disposition") == "matched").alias("n_matched"), F.count_if(F.col("disposition") == "drop").alias("n_drop"))
        .withColumn("operator", F.coalesce("operator", F.lit("(all)")))
    )


@query(
    "samples_per_group",
    """SELECT disposition, sample_no, row_id FROM (SELECT disposition, row_id, row_number() OVER (PARTITION BY disposition ORDER BY row_id) AS sample_no FROM {zero_classified}) WHERE sample_no <= 5""",
)
def _(x):
    from octroi.operators.ranking import first_per_group

    z = cleaning.zero_price_disposition(x.fares, x.gates)
    return first_per_group(z, ["disposition"], "row_id", 5).select("disposition", F.col("sample_no").cast("bigint").alias("sample_no"), "row_id")


@query(
    "class_prices",
    "SELECT row_id, round(class1 * 1.5466, 6) AS class2, round(class1 * 2.4801, 6) AS class3, round(class1 * 3.3333, 6) AS class4, round(class1 * 0.5849, 6) AS class5 FROM {fares}",
)
def _(x):
    return cleaning.class_prices(x.fares).select("row_id", *[F.round(f"class{k}", 6).alias(f"class{k}") for k in range(2, 6)])
