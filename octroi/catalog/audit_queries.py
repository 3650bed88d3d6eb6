"""Coverage, asymmetry, distance checks, quarantine and matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.cleaning_queries import far_ends, flagged_fares, suspect_ids
from octroi.catalog.registry import VIEWS, query, tokens, view
from octroi.operators import audits, cleaning, matrix


def r(c: str, digits: int, name: str | None = None):
    return F.round(c, digits).alias(name or c)


@query("fk_check", "SELECT row_id, 'from' AS endpoint, from_gare_id AS gare_id FROM {far_ends} WHERE from_gare_id NOT IN (SELECT gare_id FROM {gates}) UNION ALL SELECT row_id, 'to', to_gare_id FROM {far_ends} WHERE to_gare_id NOT IN (SELECT gare_id FROM {gates})")
def _(x):
    return audits.fk_violations(far_ends(x), x.gates)


view(
    "coverage",
    """SELECT f.operator, n_rows, n_gates, n_gates * (n_gates - 1) AS dense, CASE WHEN n_gates > 1 THEN n_rows / (n_gates * (n_gates - 1)) ELSE 0.0 END AS ratio
  FROM (SELECT operator, count(*) AS n_rows FROM {fares} GROUP BY operator) f
  JOIN (SELECT operator, count(DISTINCT g) AS n_gates FROM (SELECT operator, from_gare_id AS g FROM {fares} UNION ALL SELECT operator, to_gare_id FROM {fares}) GROUP BY operator) g ON g.operator = f.operator""",
)


@query("coverage_by_operator", "SELECT operator, n_rows, n_gates, dense, round(ratio, 9) AS ratio, dense > 0 AND ratio < 0.1 AS flagged FROM {coverage}")
def _(x):
    c = audits.coverage_by_operator(x.fares)
    return c.select("operator", "n_rows", "n_gates", "dense", r("ratio", 9), "flagged")


@query("coverage_order", "SELECT CAST(row_number() OVER (ORDER BY n_rows DESC, operator) AS BIGINT) AS place, operator, n_rows FROM {coverage}")
def _(x):
    from pyspark.sql.window import Window

    # One row per operator is left, so a single ordered window is bounded by the operator list.
    per_op = x.fares.groupBy("operator").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.orderBy(F.col("n_rows").desc(), "operator")
    return per_op.select(F.row_number().over(w).cast("bigint").alias("place"), "operator", "n_rows")


view(
    "first_prices",
    "SELECT operator, from_gare_id, to_gare_id, arg_min(class1, row_id) AS price FROM {fares} WHERE from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL GROUP BY ALL",
)


@query(
    "reverse_pairs",
    "SELECT p.*, q.price AS back_price, q.operator IS NOT NULL AS has_back FROM {first_prices} p LEFT JOIN {first_prices} q ON q.operator = p.operator AND q.from_gare_id = p.to_gare_id AND q.to_gare_id = p.from_gare_id",
)
def _(x):
    return audits.reverse_pairs(x.fares)


@query(
    "asymmetry_audit",
    """SELECT count(*) FILTER (has AND from_gare_id <= to_gare_id) AS bidirectional_pairs, count(*) FILTER (NOT has) AS unidirectional_pairs,
    count(*) FILTER (has AND from_gare_id <= to_gare_id AND price > 0 AND back > 0 AND greatest(price, back) / least(price, back) > 2) AS ratio_flagged
  FROM (SELECT p.*, q.price AS back, q.operator IS NOT NULL AS has FROM {first_prices} p LEFT JOIN {first_prices} q ON q.operator = p.operator AND q.from_gare_id = p.to_gare_id AND q.to_gare_id = p.from_gare_id)""",
)
def _(x):
    return audits.asymmetry_audit(x.fares)


@query("cheapest_fares", "SELECT from_gare_id, to_gare_id, min(class1) AS price FROM {flagged_fares} WHERE NOT quarantined AND from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL GROUP BY ALL")
def _(x):
    return audits.cheapest_fares(flagged_fares(x))


view("road_members", f"SELECT gare_id, unnest({tokens('all_routes')}) AS corridor FROM {{gates}}")


@query(
    "corridor_summary",
    """SELECT s.corridor, n_gates, coalesce(referencing, 0) AS referencing, coalesce(pure, 0) AS pure, coalesce(self_loops, 0) AS self_loops,
    coalesce(referencing, 0) > 0 AS present, coalesce(referencing, 0) = 0 AS override_needed
  FROM (SELECT corridor, count(*) AS n_gates FROM {road_members} GROUP BY corridor) s LEFT JOIN (
    SELECT corridor, count(*) AS referencing, count(*) FILTER (fin AND tin) AS pure, count(*) FILTER (same) AS self_loops FROM (
      SELECT c.corridor, f.row_id, bool_or(c.gare_id = f.from_gare_id) AS fin, bool_or(c.gare_id = f.to_gare_id) AS tin, bool_or(coalesce(f.from_gare_id = f.to_gare_id, FALSE)) AS same
      FROM {fares} f JOIN {road_members} c ON c.gare_id = f.from_gare_id OR c.gare_id = f.to_gare_id GROUP BY c.corridor, f.row_id) GROUP BY corridor) u ON u.corridor = s.corridor""",
)
def _(x):
    return audits.corridor_summary(x.fares, x.gates)


# --- matrix ------------------------------------------------------------------------------------

view(
    "fare_legs",
    """SELECT f.*, a.pid AS from_pid, b.pid AS to_pid, m.tolled_s, m.tolled_m, m.free_s, m.free_m FROM {fares} f
  LEFT JOIN {points} a ON a.gare_id = f.from_gare_id LEFT JOIN {points} b ON b.gare_id = f.to_gare_id
  LEFT JOIN {legs} m ON m.from_pid = a.pid AND m.to_pid = b.pid""",
)


@query("matrix_lookup", "SELECT row_id, from_pid, to_pid, tolled_s, tolled_m, free_s, free_m FROM {fare_legs}")
def _(x):
    return matrix.matrix_lookup(x.fares, x.points, x.legs).select(
        "row_id", "from_pid", "to_pid", "tolled_s", "tolled_m", "free_s", "free_m"
    )


view("n_points", "SELECT count(DISTINCT pid) AS n FROM {points}")


@query(
    "matrix_null_counts",
    """SELECT n * (n - 1) - count(tolled_s) AS missing_tolled_s, n * (n - 1) - count(tolled_m) AS missing_tolled_m,
    n * (n - 1) - count(free_s) AS missing_free_s, n * (n - 1) - count(free_m) AS missing_free_m FROM {legs}, {n_points} GROUP BY n""",
)
def _(x):
    return matrix.null_counts(x.legs, x.points)


view(
    "isolated",
    """SELECT p.pid, n - 1 - coalesce(o, 0) AS out_missing, n - 1 - coalesce(i, 0) AS in_missing
  FROM (SELECT DISTINCT pid FROM {points}) p, {n_points}
  LEFT JOIN (SELECT from_pid, count(free_m) AS o FROM {legs} GROUP BY 1) a ON a.from_pid = p.pid
  LEFT JOIN (SELECT to_pid, count(free_m) AS i FROM {legs} GROUP BY 1) b ON b.to_pid = p.pid
  WHERE n - 1 - coalesce(o, 0) >= (n - 1) * 0.9 OR n - 1 - coalesce(i, 0) >= (n - 1) * 0.9""",
)


@query("isolated_points", "SELECT * FROM {isolated}")
def _(x):
    return matrix.isolated_points(x.legs, x.points)


@query(
    "isolation_summary",
    """SELECT count(*) AS total_missing, (SELECT count(*) FROM {isolated}) AS isolated_point_count,
    count(*) FILTER (a.pid IN (SELECT pid FROM {isolated}) OR b.pid IN (SELECT pid FROM {isolated})) AS missing_touching_isolated
  FROM (SELECT DISTINCT pid FROM {points}) a CROSS JOIN (SELECT DISTINCT pid FROM {points}) b
  LEFT JOIN {legs} m ON m.from_pid = a.pid AND m.to_pid = b.pid WHERE a.pid <> b.pid AND m.free_m IS NULL""",
)
def _(x):
    return matrix.isolation_summary(x.legs, x.points)


@query(
    "physical_clusters",
    """SELECT CAST(row_number() OVER (ORDER BY pid) AS BIGINT) AS physical_gate_id, pid, lat, lon, members, ids FROM (
    SELECT min(gare_id) AS pid, lat, lon, count(*) AS members, array_to_string(list_sort(list(gare_id)), ',') AS ids FROM {gates} WHERE lat IS NOT NULL GROUP BY lat, lon)""",
)
def _(x):
    c = matrix.physical_clusters(x.gates)
    ids = F.array_join(F.transform("gare_ids", lambda g: g.cast("string")), ",")
    return c.select("physical_gate_id", "pid", "lat", "lon", "members", ids.alias("ids"))


view(
    "raw_legs",
    """SELECT from_pid, to_pid, 1 AS leg_no, tolled_s + 1 AS tolled_s, tolled_m + 1 AS tolled_m, free_s, free_m FROM {legs} WHERE (from_pid + to_pid) % 5 = 0
  UNION ALL SELECT from_pid, CASE WHEN to_pid % 31 = 3 THEN to_pid + 900000000 ELSE to_pid END AS to_pid, 2 AS leg_no, tolled_s, tolled_m, free_s, free_m FROM {legs}""",
)


@query(
    "matrix_from_legs",
    """SELECT from_pid, to_pid, round(CAST(arg_max_null(CAST(tolled_s AS FLOAT), leg_no) AS DOUBLE), 1) AS tolled_s, CAST(arg_max_null(CAST(tolled_m AS FLOAT), leg_no) AS DOUBLE) AS tolled_m,
    round(CAST(arg_max_null(CAST(free_s AS FLOAT), leg_no) AS DOUBLE), 1) AS free_s, CAST(arg_max_null(CAST(free_m AS FLOAT), leg_no) AS DOUBLE) AS free_m
  FROM (SELECT from_pid, to_pid, 1 AS leg_no, tolled_s + 1 AS tolled_s, tolled_m + 1 AS tolled_m, free_s, free_m FROM {legs} WHERE (from_pid + to_pid) % 5 = 0
    UNION ALL SELECT from_pid, to_pid, 2, tolled_s, tolled_m, free_s, free_m FROM {legs} WHERE to_pid % 31 <> 3) GROUP BY ALL""",
)
def _(x):
    m = matrix.from_legs(x.spark.sql(VIEWS["raw_legs"], legs=x.legs), x.points)
    return m.select("from_pid", "to_pid", r("tolled_s", 1), "tolled_m", r("free_s", 1), "free_m")


view(
    "led_points",
    """SELECT pid, arg_min(anchor_lat, gare_id) FILTER (direction = 'exit') AS xlat, arg_min(anchor_lon, gare_id) FILTER (direction = 'exit') AS xlon,
    arg_min(anchor_lat, gare_id) FILTER (direction = 'entry') AS elat, arg_min(anchor_lon, gare_id) FILTER (direction = 'entry') AS elon
  FROM {anchors} JOIN {points} USING (gare_id) GROUP BY pid""",
)


@query(
    "anchor_coords",
    """SELECT p.pid, round(coalesce(xlat, lat), 6) AS source_lat, round(coalesce(xlon, lon), 6) AS source_lon, round(coalesce(elat, lat), 6) AS target_lat, round(coalesce(elon, lon), 6) AS target_lon
  FROM (SELECT pid, min(lat) AS lat, min(lon) AS lon FROM {points} JOIN {gates} USING (gare_id) GROUP BY pid) p LEFT JOIN {led_points} l ON l.pid = p.pid""",
)
def _(x):
    a = matrix.anchor_coords(x.gates, x.points, x.anchors)
    return a.select("pid", *[r(c, 6) for c in ("source_lat", "source_lon", "target_lat", "target_lon")])


@query("seeded_pair_sample", "SELECT from_pid, to_pid, free_m FROM {legs} WHERE free_m IS NOT NULL ORDER BY md5(concat_ws('-', from_pid, to_pid)), from_pid, to_pid LIMIT 10")
def _(x):
    from octroi.operators.ranking import sampled_rows

    legs = x.legs.where("free_m IS NOT NULL").select("from_pid", "to_pid", "free_m")
    return sampled_rows(legs, ["from_pid", "to_pid"], 10)


# --- distance checks ---------------------------------------------------------------------------

view(
    "status",
    """SELECT row_id, operator, from_gare_id, to_gare_id, distance_km, tolled_m / 1000 AS measured_km, (tolled_m / 1000 - distance_km) / distance_km AS error,
    CASE WHEN from_pid IS NULL OR to_pid IS NULL THEN 'no_coordinates' WHEN from_pid = to_pid THEN 'same_point' WHEN tolled_m IS NULL THEN 'no_route' ELSE 'checked' END AS status
  FROM {fare_legs} WHERE distance_km IS NOT NULL AND from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL""",
)
view("checks", "SELECT * FROM {status} WHERE status = 'checked'")


def checks(x):
    return audits.distance_checks(x.fares, x.points, x.legs)


@query("distance_checks", "SELECT row_id, status, round(measured_km, 6) AS measured_km, round(error, 9) AS error FROM {status}")
def _(x):
    s = audits.distance_status(x.fares, x.points, x.legs)
    return s.select("row_id", "status", r("measured_km", 6), r("error", 9))


view(
    "votes",
    "SELECT g AS gare_id, count(*) AS checked, count(*) FILTER (abs(error) > 0.2) AS bad FROM (SELECT unnest([from_gare_id, to_gare_id]) AS g, error FROM {checks}) GROUP BY g HAVING count(*) >= 3 AND count(*) FILTER (abs(error) > 0.2) / count(*) >= 0.5",
)


@query("gate_error_vote", "SELECT * FROM {votes}")
def _(x):
    return audits.gate_error_vote(checks(x))


view("op_medians", "SELECT operator, median(1 + error) AS med FROM {checks} GROUP BY operator")
view(
    "rejects",
    """SELECT c.*, least(p.dev, coalesce(q.dev, p.dev)) AS adjusted, least(p.dev, coalesce(q.dev, p.dev)) > 0.2 AS rejected
  FROM {checks} c JOIN {pair_dev} p ON p.from_gare_id = c.from_gare_id AND p.to_gare_id = c.to_gare_id
  LEFT JOIN {pair_dev} q ON q.from_gare_id = c.to_gare_id AND q.to_gare_id = c.from_gare_id""",
)
view(
    "pair_dev",
    "SELECT from_gare_id, to_gare_id, arg_max(abs((1 + error) / coalesce(nullif(med, 0), 1) - 1), row_id) AS dev FROM {checks} JOIN {op_medians} USING (operator) GROUP BY ALL",
)


@query("operator_medians", "SELECT operator, round(med, 9) AS median_ratio FROM {op_medians}")
def _(x):
    return audits.operator_medians(checks(x)).select("operator", r("median_ratio", 9))


@query("row_rejects", "SELECT row_id, round(adjusted, 6) AS adjusted, rejected FROM {rejects}")
def _(x):
    return audits.row_rejects(checks(x)).select("row_id", r("adjusted", 6), "rejected")


view("reject_pairs", "SELECT from_gare_id, to_gare_id FROM {rejects} WHERE rejected UNION SELECT to_gare_id, from_gare_id FROM {rejects} WHERE rejected")


@query("symmetric_pairs", "SELECT * FROM {reject_pairs}")
def _(x):
    return audits.symmetric_pairs(audits.row_rejects(checks(x)).where("rejected"))


@query(
    "quarantine_rows",
    "SELECT row_id, (from_gare_id, to_gare_id) IN (SELECT (from_gare_id, to_gare_id) FROM {reject_pairs}) AND from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL AS quarantined FROM {fares}",
)
def _(x):
    return audits.quarantine_rows(x.fares, audits.row_rejects(checks(x))).select("row_id", "quarantined")


view(
    "scores0",
    """SELECT gare_id, CASE WHEN gare_id % 4 = 0 THEN 'LIKELY_INVALID' WHEN gare_id % 4 = 1 THEN 'UNCERTAIN' ELSE 'LIKELY_VALID' END AS verdict,
  CASE WHEN gare_id % 12 = 0 THEN 'VIRTUAL|OD_SINK_ONLY' WHEN gare_id % 8 = 0 THEN 'VIRTUAL' ELSE 'BRETELLE' END AS flags FROM {gates}""",
)
view("unreal", "SELECT gare_id FROM {scores0} WHERE verdict = 'LIKELY_INVALID' AND flags = 'VIRTUAL|OD_SINK_ONLY'")
view(
    "confirmed",
    """SELECT i.gare_id, coalesce(bad, 0) AS bad, coalesce(checked, 0) AS checked FROM (
    SELECT gare_id FROM {votes} WHERE gare_id IN (SELECT gare_id FROM {scores0} WHERE verdict = 'LIKELY_INVALID') UNION SELECT gare_id FROM {unreal}) i
  LEFT JOIN {votes} v ON v.gare_id = i.gare_id""",
)


def scores0(x):
    return x.spark.sql(VIEWS["scores0"], gates=x.gates)


@query("non_physical_gates", "SELECT gare_id FROM {unreal}")
def _(x):
    return cleaning.non_physical(scores0(x)).select("gare_id")


@query("released_gates", "SELECT gare_id FROM {votes} WHERE gare_id NOT IN (SELECT gare_id FROM {confirmed})")
def _(x):
    v = audits.gate_error_vote(checks(x))
    return audits.released_gates(v, audits.confirmed_gates(v, scores0(x)))


@query(
    "quarantine_gates",
    """SELECT gare_id, reason, affected FROM (
    SELECT gare_id, 'snap_distance_over_200m' AS reason, coalesce(affected, 0) AS affected FROM {suspects} LEFT JOIN {refs} USING (gare_id) WHERE gare_id NOT IN (SELECT gare_id FROM {confirmed})
    UNION ALL SELECT gare_id, 'distance_error_over_20pct', checked FROM {confirmed})""",
)
def _(x):
    s = cleaning.snap_suspects(x.gates, x.fares)
    v = audits.gate_error_vote(checks(x))
    return audits.quarantine_gates(s, v, scores0(x), x.gates).select("gare_id", "reason", "affected")


_PICK = "max(e) FILTER (r = least(n, CAST(floor(n * {p} / 100.0) AS BIGINT) + 1))"


@query(
    "error_percentiles",
    "SELECT max(n) AS n, round(avg(e), 9) AS mean, "
    + ", ".join(f"round({_PICK.replace('{p}', str(p))}, 9) AS {k}" for k, p in {"median": 50, "p75": 75, "p90": 90, "p95": 95, "p99": 99}.items())
    + ", round(max(e), 9) AS max FROM (SELECT abs(error) AS e, row_number() OVER (ORDER BY abs(error)) AS r, count(*) OVER () AS n FROM {checks})",
)
def _(x):
    p = audits.error_percentiles(checks(x))
    return p.select("n", *[r(c, 9) for c in p.columns if c != "n"])


view("live", "SELECT from_gare_id, to_gare_id, min(measured_km * (1 + CAST((from_gare_id + to_gare_id) % 5 AS DOUBLE) / 30)) AS live_km FROM {checks} GROUP BY ALL")


@query(
    "distance_source_agreement",
    """SELECT count(*) AS compared, round(avg(CAST(abs(measured_km / live_km - 1) <= 0.1 AS DOUBLE)), 9) AS agreement, avg(CAST(abs(measured_km / live_km - 1) <= 0.1 AS DOUBLE)) >= 0.8 AS trusted
  FROM (SELECT * FROM {checks} ORDER BY md5(CAST(row_id AS VARCHAR)), row_id LIMIT 40) s JOIN {live} USING (from_gare_id, to_gare_id)""",
)
def _(x):
    c = checks(x)
    k = (1 + ((F.col("from_gare_id") + F.col("to_gare_id")) % 5).cast("double") / 30)
    live = c.groupBy("from_gare_id", "to_gare_id").agg(F.min("measured_km").alias("m")).withColumn("live_km", F.col("m") * k).drop("m")
    return audits.distance_source_agreement(c, live).select("compared", r("agreement", 9), "trusted")


@query(
    "ratio_summary",
    """SELECT operator, n_rows, comparable, no_route, round(mean_ratio, 6) AS mean_ratio, within_20pct, outliers, median_ratio FROM (
    SELECT operator, count(*) AS n_rows, count(ratio) AS comparable, count(*) - count(ratio) AS no_route, avg(ratio) AS mean_ratio,
      count(*) FILTER (ratio BETWEEN 0.8 AND 1.2) AS within_20pct, count(*) FILTER (ratio NOT BETWEEN 0.8 AND 1.2) AS outliers,
      list_extract(list_sort(list(ratio) FILTER (ratio IS NOT NULL)), count(ratio) // 2 + 1) AS median_ratio
    FROM (SELECT operator, CASE WHEN status = 'checked' THEN round(measured_km / distance_km, 4) END AS ratio FROM {status}) GROUP BY operator)""",
)
def _(x):
    s = audits.ratio_summary(audits.distance_status(x.fares, x.points, x.legs))
    return s.select("operator", "n_rows", "comparable", "no_route", r("mean_ratio", 6), "within_20pct", "outliers", "median_ratio")


@query("top_deviation", "SELECT row_id, operator, round(abs(error), 9) AS deviation FROM {checks} ORDER BY abs(error) DESC, row_id LIMIT 15")
def _(x):
    return audits.top_deviation(checks(x)).select("row_id", "operator", F.round(F.abs("error"), 9).alias("deviation"))


# --- sourced prices ----------------------------------------------------------------------------

view(
    "sourced",
    """SELECT operator, from_gare, to_gare, CAST(1 + min(row_id) % 5 AS INT) AS vehicle_class, min(class1) * 1.2 + 1 AS oracle_price_eur, 30.0 + min(row_id) % 3 * 20 AS tolerance_pct
  FROM {fares} GROUP BY operator, from_gare, to_gare""",
)


@query(
    "oracle_join",
    """SELECT s.operator, s.from_gare, s.to_gare, s.vehicle_class, round(price, 6) AS fare_eur, round((price - oracle_price_eur) / oracle_price_eur * 100, 6) AS error_pct,
    abs((price - oracle_price_eur) / oracle_price_eur * 100) <= tolerance_pct AS passed
  FROM (SELECT s.*, l.c1 * CASE s.vehicle_class WHEN 1 THEN 1 WHEN 2 THEN 1.5466::DOUBLE WHEN 3 THEN 2.4801::DOUBLE WHEN 4 THEN 3.3333::DOUBLE ELSE 0.5849::DOUBLE END AS price
    FROM {sourced} s JOIN (SELECT operator, from_gare, to_gare, arg_max(class1, row_id) AS c1 FROM {fares} GROUP BY ALL) l USING (operator, from_gare, to_gare)) s""",
)
def _(x):
    prices = x.spark.sql(VIEWS["sourced"], fares=x.fares)
    j = audits.oracle_join(prices, cleaning.class_prices(x.fares))
    return j.select("operator", "from_gare", "to_gare", "vehicle_class", r("fare_eur", 6), r("error_pct", 6), "passed")


view("named_pairs", "SELECT DISTINCT 'P' || CAST(from_gare_id AS STRING) || '-' || CAST(to_gare_id AS STRING) AS label, from_gare_id, to_gare_id FROM {fares} WHERE class1 > 0 AND from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL")


@query(
    "fare_pair_verify",
    """SELECT label, price AS price_eur, tolled_m, free_m, tolled_m <> free_m OR tolled_s <> free_s AS distinct_route FROM (
    SELECT label, n.from_gare_id, n.to_gare_id, arg_min(class1, row_id) AS price FROM {named_pairs} n JOIN {fares} f ON f.from_gare_id = n.from_gare_id AND f.to_gare_id = n.to_gare_id GROUP BY ALL) n
  LEFT JOIN {points} a ON a.gare_id = n.from_gare_id LEFT JOIN {points} b ON b.gare_id = n.to_gare_id LEFT JOIN {legs} m ON m.from_pid = a.pid AND m.to_pid = b.pid""",
)
def _(x):
    pairs = x.spark.sql(VIEWS["named_pairs"], fares=x.fares)
    v = audits.fare_pair_verify(pairs, x.fares, x.points, x.legs)
    return v.select("label", "price_eur", "tolled_m", "free_m", "distinct_route")
