"""Readers, writers, small expressions, samples and the batch build."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.audit_queries import r, scores0
from octroi.catalog.cleaning_queries import class_costs, suspect_ids
from octroi.catalog.option_queries import option_table
from octroi.catalog.place_queries import found_anchors
from octroi.catalog.registry import VIEWS, query, view
from octroi.functions import geo, pricing, text
from octroi.operators import cleaning, matrix, places, sampling, steps
from octroi.operators.ranking import row_positions
from octroi.plans import national
from octroi.plans import requests as req
from octroi.session import scratch_path
from octroi.sources import files, sinks


def _as(df, schema):
    """The frame in a file's column layout; columns it lacks stay blank."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def fares_csv(x):
    return sinks.write_csv(_as(cleaning.class_prices(x.fares), files.FARE_SCHEMA), scratch_path(x.spark, "fares-csv"))


@query("scan_fares_csv", "SELECT row_id, from_gare_id, to_gare_id, operator, to_gare, distance_km, start_time, class1, round(class1 * 1.5466::DOUBLE, 6) AS class2 FROM {fares}")
def _(x):
    f = files.read_fares(x.spark, fares_csv(x))
    return f.select("row_id", "from_gare_id", "to_gare_id", "operator", "to_gare", "distance_km", "start_time", "class1", r("class2", 6))


@query("scan_gates_csv", "SELECT gare_id, canonical_name, nullif(primary_route, '') AS primary_route, operators, lat, lon, match_tier FROM {gates}")
def _(x):
    path = sinks.write_csv(_as(x.gates, files.GATE_SCHEMA), scratch_path(x.spark, "gates-csv"))
    return files.read_gates(x.spark, path).select("gare_id", "canonical_name", "primary_route", "operators", "lat", "lon", "match_tier")


@query("scan_gates_lenient", "SELECT gare_id, lat, lat IS NOT NULL AS placed FROM {gates} WHERE gare_id % 23 <> 7")
def _(x):
    raw = _as(x.gates, files.GATE_SCHEMA).withColumn(
        "gare_id", F.when(F.col("gare_id") % 23 == 7, F.concat(F.lit("n/a "), F.col("gare_id").cast("string"))).otherwise(F.col("gare_id").cast("string"))
    )
    placed, lost = files.read_gates_lenient(x.spark, sinks.write_csv(raw, scratch_path(x.spark, "gates-raw")))
    a = placed.select("gare_id", "lat", F.lit(True).alias("placed"))
    return a.unionByName(lost.select("gare_id", F.col("lat").cast("double").alias("lat"), F.lit(False).alias("placed")))


@query(
    "scan_subset_by_operator",
    "SELECT 'fare' AS kind, row_id AS id FROM {fares} WHERE operator = 'OP1' UNION ALL SELECT 'gate', gare_id FROM {gates} WHERE list_contains(string_split(replace(operators, ' ', ''), '|'), 'OP1')",
)
def _(x):
    f, g = files.one_operator(x.fares, x.gates, "OP1")
    return f.select(F.lit("fare").alias("kind"), F.col("row_id").alias("id")).union(g.select(F.lit("gate"), "gare_id"))


@query("scan_verdicts_optional", "SELECT gare_id, verdict FROM {scores0}")
def _(x):
    path = sinks.write_csv(_as(scores0(x), files.VERDICT_SCHEMA), scratch_path(x.spark, "verdicts"))
    absent = files.read_verdicts(x.spark, scratch_path(x.spark, "absent"))
    return files.read_verdicts(x.spark, path).unionByName(absent).select("gare_id", "verdict")


@query("scan_oracle_prices", "SELECT operator, from_gare, to_gare, vehicle_class, round(oracle_price_eur, 6) AS oracle_price_eur, tolerance_pct FROM {sourced}")
def _(x):
    prices = x.spark.sql(VIEWS["sourced"], fares=x.fares)
    path = sinks.write_csv(_as(prices, files.PRICE_SCHEMA), scratch_path(x.spark, "prices"))
    p = files.read_prices(x.spark, path)
    return p.select("operator", "from_gare", "to_gare", "vehicle_class", r("oracle_price_eur", 6), "tolerance_pct")


view(
    "tariffs",
    "SELECT from_gare_id AS a, to_gare_id AS b, min(CAST(round(class1 * 10) AS BIGINT)) AS c, max(CAST(round(class1 * 10) AS BIGINT)) + 7 AS d FROM {fares} WHERE from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL GROUP BY from_gare_id, to_gare_id",
)


def tariff_lines(x):
    """Three grids in their own layouts: an outdated line before each price line, and lines that fit nothing."""
    t = x.spark.sql(VIEWS["tariffs"], fares=x.fares)

    def prices(c):
        return F.concat_ws("  ", *[F.concat(F.regexp_replace(F.format_string("%.1f", (F.col(c) + k) / 10), r"\.", ","), F.lit(" €")) for k in range(5)])

    a, b = F.concat(F.lit("GARE No "), F.col("a").cast("string")), F.concat(F.lit("SORTIE "), F.col("b").cast("string"))
    kind = (F.col("a") + F.col("b")) % 3

    def line(c):
        return (
            F.when(kind == 0, F.concat(a, F.lit("   "), b, F.lit("  12,5  "), prices(c)))
            .when(kind == 1, F.concat(F.lit("017 "), a, F.lit("   233 "), b, F.lit(" 8,0 "), prices(c)))
            .otherwise(F.concat(F.lit(" A11   1   "), a, F.lit("   A10   -   "), b, F.lit("   "), prices(c)))
        )

    both = F.concat_ws("\n", line("c"), F.concat(F.lit("Tarifs "), F.col("a").cast("string")), line("d"))
    names = ("plain", "coded", "junction")
    out = {}
    for i, n in enumerate(names):
        path = scratch_path(x.spark, f"tariff-{n}")
        t.where(kind == i).select(both.alias("value")).write.text(path)
        out[n] = path
    return out


@query(
    "parse_tariff_text",
    "SELECT 'GARE No ' || a AS from_gare, 'SORTIE ' || b AS to_gare, round(d / 10, 4) AS class1, round((d + 4) / 10, 4) AS class5 FROM {tariffs}",
)
def _(x):
    out = None
    for layout, path in tariff_lines(x).items():
        t = files.parse_tariff_text(files.read_tariff_lines(x.spark, path), layout)
        out = t if out is None else out.unionByName(t)
    return out.select("from_gare", "to_gare", r("class1", 4), r("class5", 4))


@query("matrix_write", "SELECT from_pid, to_pid, round(tolled_s, 1) AS tolled_s, tolled_m, round(free_s, 1) AS free_s, free_m FROM {legs}")
def _(x):
    m = x.spark.read.parquet(files.write_matrix(x.legs, scratch_path(x.spark, "matrix")))
    return m.select("from_pid", "to_pid", *[F.round(F.col(c).cast("double"), 1).alias(c) for c in matrix.CELLS])


@query("matrix_load_checked", "SELECT count(*) AS n_cells, count(DISTINCT from_pid) AS n_sources, count(free_m) AS n_free FROM {legs}")
def _(x):
    m = files.load_matrix(x.spark, files.write_matrix(x.legs, scratch_path(x.spark, "matrix")), x.points)
    return m.agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("from_pid").alias("n_sources"), F.count("free_m").alias("n_free"))


@query("table_rebuild", "SELECT row_id, class1 FROM {fares}")
def _(x):
    path = scratch_path(x.spark, "rebuild")
    sinks.table_rebuild(x.fares.limit(0), path)
    return sinks.table_rebuild(x.fares, path).select("row_id", "class1")


@query(
    "table_upsert",
    "SELECT gare_id, 'old' AS source FROM {gates} WHERE gare_id % 3 <> 0 AND NOT gare_id % 4 = 1 UNION ALL SELECT gare_id, 'new' FROM {gates} WHERE gare_id % 4 = 1",
)
def _(x):
    old = x.gates.where("gare_id % 3 <> 0").select("gare_id", F.lit("old").alias("source"))
    new = x.gates.where("gare_id % 4 = 1").select("gare_id", F.lit("new").alias("source"))
    return sinks.table_upsert(old, new, ["gare_id"], scratch_path(x.spark, "upsert"))


@query(
    "seed_if_empty",
    "SELECT r.vehicle_class, per_km, per_hour, count(*) AS n_requests FROM {requests} r JOIN {class_costs} c ON c.vehicle_class = r.vehicle_class GROUP BY ALL",
)
def _(x):
    full = sinks.default_classes(x.spark)
    seeded = sinks.seed_if_empty(full.limit(0), full)
    kept = sinks.seed_if_empty(seeded, full.withColumn("per_km", F.lit(9.0)))
    # Counted per class before the costs are joined: five classes would be five tasks for all requests.
    counted = x.requests.groupBy("vehicle_class").agg(F.count(F.lit(1)).alias("n_requests"))
    return counted.join(kept, "vehicle_class").groupBy("vehicle_class", "per_km", "per_hour").agg(F.sum("n_requests").alias("n_requests"))


view(
    "charges",
    "SELECT 'C' || CAST(gare_id AS STRING) AS corridor, 'CEV' AS operator, gare_id + 900000000 AS gare_id, 'GANTRY ' || CAST(gare_id AS STRING) AS canonical_name, lat, lon, CAST(500 + gare_id * 37 % 900 AS DOUBLE) / 100 AS class1 FROM {gates} WHERE gare_id % 10 = 1 AND lat IS NOT NULL",
)


def charges(x):
    return x.spark.sql(VIEWS["charges"], gates=x.gates)


@query(
    "seed_flat_fee",
    """SELECT 'gate' AS kind, gare_id AS id, NULL::DOUBLE AS fee FROM {gates} UNION ALL SELECT 'gate', gare_id, NULL FROM {charges}
  UNION ALL SELECT 'fare', row_id, class1 FROM {fares} UNION ALL SELECT 'fare', -gare_id, class1 FROM {charges}
  UNION ALL SELECT 'fee' || k, gare_id, CASE WHEN k = 1 THEN class1 ELSE round(class1 * r, 2) END FROM {charges}, (VALUES (1, 1.0::DOUBLE), (2, 1.5466), (3, 2.4801), (4, 3.3333), (5, 0.5849)) v(k, r)""",
)
def _(x):
    c = charges(x)
    empty = x.spark.createDataFrame([], "corridor string, vehicle_class int, flat_fee_eur double, operator string, is_conjecture boolean")
    g, f, o = sinks.seed_flat_fee(c, x.gates, cleaning.class_prices(x.fares), empty)
    g, f, o = sinks.seed_flat_fee(c, g, f, o)  # a second run changes nothing
    ids = c.select("corridor", "gare_id")
    return (
        g.select(F.lit("gate").alias("kind"), F.col("gare_id").alias("id"), F.lit(None).cast("double").alias("fee"))
        .unionByName(f.select(F.lit("fare").alias("kind"), F.col("row_id").alias("id"), F.col("class1").alias("fee")))
        .unionByName(o.join(ids, "corridor").select(F.concat(F.lit("fee"), F.col("vehicle_class").cast("string")).alias("kind"), F.col("gare_id").alias("id"), F.col("flat_fee_eur").alias("fee")))
    )


@query("add_missing_columns", "SELECT row_id, FALSE AS quarantined, NULL::VARCHAR AS quarantine_reason FROM {fares}")
def _(x):
    once = sinks.with_quarantine_columns(x.fares)
    return sinks.with_quarantine_columns(once).select("row_id", "quarantined", "quarantine_reason")


@query("sink_csv", "SELECT row_id, operator, class1 FROM {fares}")
def _(x):
    path = sinks.write_csv(x.fares.select("row_id", "operator", "class1"), scratch_path(x.spark, "csv"))
    return x.spark.read.csv(path, header=True, schema="row_id bigint, operator string, class1 double")


@query("sink_json", "SELECT row_id, operator, class1 FROM {fares}")
def _(x):
    path = sinks.write_json(x.fares.select("row_id", "operator", "class1"), scratch_path(x.spark, "json"))
    return x.spark.read.schema("row_id bigint, operator string, class1 double").json(path)


_GROUP = ", ".join(req.GROUP)


@query("sink_option_log", f"SELECT {_GROUP}, count(*) AS n_options, sum(CASE WHEN chain = '' THEN 0 ELSE len(string_split(chain, ',')) END)::BIGINT AS n_gates FROM {{opts}} GROUP BY ALL")
def _(x):
    path = sinks.sink_option_log(option_table(x), req.GROUP, scratch_path(x.spark, "option-log"))
    shape = "origin_id bigint, destination_id bigint, vehicle_class int, vot_bucket bigint, options array<struct<gates:array<bigint>>>"
    log = x.spark.read.text(path).select(F.from_json("value", shape).alias("j")).select("j.*")
    n = F.aggregate("options", F.lit(0).cast("bigint"), lambda acc, v: acc + F.size(v["gates"]))
    return log.select(*req.GROUP, F.size("options").cast("bigint").alias("n_options"), n.alias("n_gates"))


# --- expressions ---------------------------------------------------------------------------------


@query(
    "detour_metrics",
    "SELECT from_pid, to_pid, round((free_m - tolled_m) / 1000, 6) AS extra_km, round((free_s - tolled_s) / 60, 6) AS extra_minutes, round(CASE WHEN (free_s - tolled_s) / 60 > 1e-9 THEN (from_pid % 30) / ((free_s - tolled_s) / 60 / 60) WHEN from_pid % 30 > 0 THEN 'inf'::DOUBLE END, 4) AS rate FROM {legs} WHERE free_s IS NOT NULL AND tolled_s IS NOT NULL",
)
def _(x):
    m = x.legs.where("free_s IS NOT NULL AND tolled_s IS NOT NULL")
    mins = pricing.extra_minutes(F.col("free_s"), F.col("tolled_s"))
    rate = pricing.eur_per_hour_saved((F.col("from_pid") % 30).cast("double"), mins)
    return m.select(
        "from_pid", "to_pid", F.round(pricing.extra_km(F.col("free_m"), F.col("tolled_m")), 6).alias("extra_km"), F.round(mins, 6).alias("extra_minutes"),
        F.when(rate == float("inf"), rate).otherwise(F.round(rate, 4)).alias("rate"),
    )


@query("fn_relative_error", "SELECT row_id, round((tolled_m / 1000 - distance_km) / distance_km, 9) AS rel, round((tolled_m / 1000 - distance_km) / distance_km * 100, 6) AS pct FROM {fare_legs} WHERE tolled_m IS NOT NULL AND distance_km <> 0")
def _(x):
    f = matrix.matrix_lookup(x.fares, x.points, x.legs).where("tolled_m IS NOT NULL AND distance_km <> 0")
    km = F.col("tolled_m") / 1000
    return f.select("row_id", F.round(pricing.relative_error(km, F.col("distance_km")), 9).alias("rel"), F.round(pricing.percent_error(km, F.col("distance_km")), 6).alias("pct"))


@query("fn_closeness", "SELECT from_pid, to_pid, abs(tolled_m - free_m) <= 0.1::DOUBLE * greatest(abs(tolled_m), abs(free_m)) AS near FROM {legs} WHERE tolled_m IS NOT NULL AND free_m IS NOT NULL")
def _(x):
    m = x.legs.where("tolled_m IS NOT NULL AND free_m IS NOT NULL")
    return m.select("from_pid", "to_pid", geo.roughly_equal(F.col("tolled_m"), F.col("free_m")).alias("near"))


@query("fn_fallback_duration", "SELECT row_id, round(coalesce(tolled_s, coalesce(distance_km, 0) * 1000 / (110.0::DOUBLE * 1000 / 3600)), 6) AS duration_s FROM {fare_legs}")
def _(x):
    f = matrix.matrix_lookup(x.fares, x.points, x.legs)
    s = F.coalesce("tolled_s", pricing.fallback_seconds(F.coalesce("distance_km", F.lit(0.0)) * 1000))
    return f.select("row_id", F.round(s, 6).alias("duration_s"))


@query("fn_decimal_comma", "SELECT row_id, class1 AS price FROM {fares}")
def _(x):
    typed = F.regexp_replace(F.col("class1").cast("string"), r"\.", ",")
    return x.fares.select("row_id", text.decimal_comma(typed).alias("price"))


@query("fn_hypot", "SELECT a.route_id, a.seq, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 2) AS len_m FROM {vxy} a JOIN {vxy} b ON b.route_id = a.route_id AND b.seq = a.seq + 1")
def _(x):
    return places.route_segments(x.vertices).select("route_id", "seq", r("len_m", 2))


@query("fn_overshoot", "SELECT route_id, round(max(seq) * 1000.0::DOUBLE - 2.0 * greatest(0.0, arg_max(lat, seq) - min(lat)) * 111000.0, 4) AS corrected_m FROM {vertices} GROUP BY route_id")
def _(x):
    v = x.vertices.groupBy("route_id").agg(F.max("seq").alias("n"), F.max_by("lat", "seq").alias("dest_lat"), F.min("lat").alias("min_lat"))
    return v.select("route_id", F.round(geo.overshoot_corrected(F.col("n") * 1000.0, F.col("dest_lat"), F.col("min_lat")), 4).alias("corrected_m"))


@query("fn_name_lower", "SELECT gare_id, trim(lower(strip_accents(canonical_name))) AS name FROM {gates}")
def _(x):
    return x.gates.select("gare_id", text.lower_bare("canonical_name").alias("name"))


# --- positions and samples -----------------------------------------------------------------------


@query("fare_row_id", "SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) AS BIGINT) AS file_position FROM {fares}")
def _(x):
    return row_positions(x.fares.select("row_id"), [], ["row_id"], out="file_position").select("row_id", "file_position")


@query(
    "city_pair_sample",
    "SELECT a AS a_place_id, b AS b_place_id, round(km, 4) AS km FROM (SELECT p.place_id AS a, q.place_id AS b, 2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) AS km FROM {places} p JOIN {places} q ON p.place_id < q.place_id) WHERE km BETWEEN 350 AND 450 ORDER BY md5(CAST(a AS VARCHAR)), md5(CAST(b AS VARCHAR)) LIMIT 25",
)
def _(x):
    return sampling.city_pair_sample(x.places).select("a_place_id", "b_place_id", r("km", 4))


# --- route steps ---------------------------------------------------------------------------------

view(
    "steps",
    "SELECT route_id, seq, is_toll, seq % 40 < 5 AS is_access, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'A' || CAST(event_id % 3 AS STRING) END AS road FROM {vertices}",
)


def step_table(x):
    return x.spark.sql(VIEWS["steps"], vertices=x.vertices)


@query(
    "segment_merge",
    """SELECT route_id, CAST(seg AS BIGINT) AS segment_no, is_toll, is_access, min(seq) AS first_seq, max(seq) AS last_seq FROM (
    SELECT *, sum(st) OVER (PARTITION BY route_id ORDER BY seq) AS seg FROM (SELECT *, CASE WHEN coalesce(lag(is_toll) OVER w = is_toll AND lag(is_access) OVER w = is_access, FALSE) THEN 0 ELSE 1 END AS st FROM {steps} WINDOW w AS (PARTITION BY route_id ORDER BY seq))) GROUP BY ALL""",
)
def _(x):
    return steps.segment_merge(step_table(x))


@query(
    "road_list",
    "SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY seq) AS BIGINT) AS road_no, road FROM (SELECT *, lag(road) OVER (PARTITION BY route_id ORDER BY seq) AS p FROM {steps} WHERE road <> '') WHERE p IS NULL OR p <> road",
)
def _(x):
    return steps.road_list(step_table(x))


@query("access_toll_roads", "SELECT DISTINCT route_id, road FROM {steps} WHERE is_toll AND is_access AND road <> ''")
def _(x):
    return steps.access_toll_roads(step_table(x))


# --- the batch build -----------------------------------------------------------------------------

view(
    "clean1",
    """SELECT f.row_id, coalesce(f.from_gare_id, a.matched_gare_id) AS from_gare_id, coalesce(f.to_gare_id, b.matched_gare_id) AS to_gare_id, f.operator, f.distance_km, f.class1 FROM {fares} f
  LEFT JOIN {resolved} a ON a.row_id = f.row_id AND a.endpoint = 'from' LEFT JOIN {resolved} b ON b.row_id = f.row_id AND b.endpoint = 'to'""",
)
view(
    "clean2",
    """SELECT row_id, CASE WHEN pf AND NOT pt THEN to_gare_id ELSE from_gare_id END AS from_gare_id, CASE WHEN pt AND NOT pf THEN from_gare_id ELSE to_gare_id END AS to_gare_id, (pf AND NOT pt) OR (pt AND NOT pf) AS remapped
  FROM (SELECT *, from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL AND coalesce(from_gare_id IN (SELECT gare_id FROM {unreal}), FALSE) AS pf, from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL AND coalesce(to_gare_id IN (SELECT gare_id FROM {unreal}), FALSE) AS pt FROM {clean1})
  WHERE row_id NOT IN (SELECT row_id FROM {zero_classified} WHERE disposition = 'drop')""",
)
view(
    "nchecks",
    """SELECT c.row_id, c.operator, c.from_gare_id, c.to_gare_id, (m.tolled_m / 1000 - distance_km) / distance_km AS error FROM {clean1} c JOIN {points} a ON a.gare_id = from_gare_id JOIN {points} b ON b.gare_id = to_gare_id
  JOIN {legs} m ON m.from_pid = a.pid AND m.to_pid = b.pid WHERE distance_km IS NOT NULL AND a.pid <> b.pid AND m.tolled_m IS NOT NULL""",
)
view("nvotes", "SELECT g AS gare_id, count(*) AS checked FROM (SELECT unnest([from_gare_id, to_gare_id]) AS g, error FROM {nchecks}) GROUP BY g HAVING count(*) >= 3 AND count(*) FILTER (abs(error) > 0.2) / count(*) >= 0.5")
view("nmed", "SELECT operator, median(1 + error) AS med FROM {nchecks} GROUP BY operator")
view("ndev", "SELECT from_gare_id AS f, to_gare_id AS t, arg_max(abs((1 + error) / coalesce(nullif(med, 0), 1) - 1), row_id) AS dev FROM {nchecks} JOIN {nmed} USING (operator) GROUP BY ALL")
view("nbad", "SELECT p.f, p.t FROM {ndev} p LEFT JOIN {ndev} q ON q.f = p.t AND q.t = p.f WHERE least(p.dev, coalesce(q.dev, p.dev)) > 0.2")
view("nconf", "SELECT gare_id FROM {nvotes} WHERE gare_id IN (SELECT gare_id FROM {scores0} WHERE verdict = 'LIKELY_INVALID') UNION SELECT gare_id FROM {unreal}")
view("nsusp", "SELECT gare_id FROM {gates} WHERE lat IS NULL UNION SELECT gare_id FROM {suspects} UNION SELECT gare_id FROM {nconf}")


@query(
    "build_summary",
    """SELECT (SELECT count(*) FROM {gates}) AS raw_gate_count, (SELECT count(*) FROM {fares}) AS raw_fare_count, (SELECT count(*) FROM {clean2}) + (SELECT count(*) FROM {charges}) AS final_fare_count,
    (SELECT count(*) FROM {clean2} WHERE remapped) AS open_system_remapped, (SELECT count(*) FROM {clean2} c JOIN (SELECT f, t FROM {nbad} UNION SELECT t, f FROM {nbad}) n ON n.f = c.from_gare_id AND n.t = c.to_gare_id) AS quarantined_fare_count,
    (SELECT count(*) FROM {gates} WHERE lat IS NOT NULL AND gare_id NOT IN (SELECT gare_id FROM {nsusp})) + (SELECT count(*) FROM {charges}) AS active_gate_count, (SELECT count(*) FROM {nsusp}) AS suspect_gate_count,
    (SELECT count(*) FROM {nconf}) AS distance_suspect_count, (SELECT count(*) FROM {zero_classified} WHERE disposition = 'drop') AS zero_drop, (SELECT count(*) FROM {zero_classified} WHERE disposition = 'free_section') AS zero_free_section,
    (SELECT count(*) FROM {zero_classified} WHERE disposition = 'free_transfer') AS zero_free_transfer, (SELECT count(*) FROM {resolved} WHERE matched_gare_id IS NOT NULL) AS rematch_matched, (SELECT count(*) FROM {resolved} WHERE matched_gare_id IS NULL) AS rematch_dropped,
    (SELECT count(*) FROM {gates} WHERE lat IS NULL) AS coordinateless_count, (SELECT count(*) FROM {suspects}) AS snap_suspect_count, (SELECT count(*) FROM {anchored}) AS access_anchor_count""",
)
def _(x):
    return national.build(x.fares, x.gates, x.legs, scores0(x), charges(x), found_anchors(x)).summary
