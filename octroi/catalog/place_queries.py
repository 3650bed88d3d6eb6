"""Distance joins, driven lines, anchors and gate scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.audit_queries import r
from octroi.catalog.cleaning_queries import joined, snap_pairs
from octroi.catalog.registry import VIEWS, flag_cases, hav, pipe_list, query, tokens, view
from octroi.functions import geo
from octroi.operators import anchors, audits, cleaning, matrix, places, scoring
from octroi.operators.ranking import sampled_rows
from octroi.operators.spatial import nearest_point
from octroi.session import written


def lamb(lat: str, lon: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    rr = f"({geo.L93_C} * exp(-{geo.L93_N} * (atanh({s}) - {geo.L93_E} * atanh({geo.L93_E} * {s}))))"
    g = f"({geo.L93_N} * radians({lon} - 3.0))"
    return f"({geo.L93_XS} + {rr} * sin({g}))", f"({geo.L93_YS} - {rr} * cos({g}))"


_X, _Y = lamb("lat", "lon")
view("placed", f"SELECT *, {_X} AS x, {_Y} AS y FROM {{gates}} WHERE lat IS NOT NULL")

# --- scalar expressions over the tables --------------------------------------------------------


@query("fn_haversine", f"SELECT a.gare_id, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371000.0)}, 3) AS metres, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371.0)}, 6) AS km FROM {{gates}} a JOIN {{hubs}} b ON b.hub_id = a.nation_id % (SELECT n FROM {{hub_count}})")
def _(x):
    h = x.hubs.select("hub_id", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    g = x.gates.withColumn("h", F.col("nation_id") % x.table("hub_count").scalar()).join(h, F.col("hub_id") == F.col("h"))
    km = geo.haversine("lat", "lon", "h_lat", "h_lon", geo.EARTH_RADIUS_KM)
    return g.select("gare_id", F.round(geo.haversine("lat", "lon", "h_lat", "h_lon"), 3).alias("metres"), F.round(km, 6).alias("km"))


@query("fn_lambert93", "SELECT gare_id, round(x, 3) AS x, round(y, 3) AS y FROM {placed}")
def _(x):
    g = geo.with_lambert(x.gates.where("lat IS NOT NULL"))
    return g.select("gare_id", r("x", 3), r("y", 3))


# --- pairs of gates ----------------------------------------------------------------------------

view(
    "transfers",
    f"""SELECT *, len(list_intersect(oa, ob)) = 0 AS boundary FROM (
    SELECT a.gare_id AS a_id, b.gare_id AS b_id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371000.0)} AS dist_m, {pipe_list('a.operators')} AS oa, {pipe_list('b.operators')} AS ob
    FROM {{gates}} a JOIN {{gates}} b ON a.gare_id < b.gare_id AND abs(a.lat - b.lat) <= 0.01 AND abs(a.lon - b.lon) <= 0.01) WHERE dist_m <= 100""",
)


def transfers(x):
    return places.transfer_pairs(x.gates)


@query(
    "transfer_pairs",
    """SELECT a_id, b_id, round(dist_m, 3) AS dist_m, CASE WHEN boundary THEN 'boundary' ELSE 'exit_reentry' END AS transfer_type,
    CASE WHEN boundary THEN 0.0::DOUBLE ELSE 180.0::DOUBLE END AS dwell_s, CASE WHEN boundary THEN 0.0::DOUBLE ELSE 500.0::DOUBLE END AS dwell_m FROM {transfers}""",
)
def _(x):
    return transfers(x).select("a_id", "b_id", r("dist_m", 3), "transfer_type", "dwell_s", "dwell_m")


@query("shared_operators", "SELECT a_id, b_id, array_to_string(list_sort(list_intersect(oa, ob)), '|') AS shared, boundary AS disjoint FROM {transfers}")
def _(x):
    return transfers(x).select(
        "a_id", "b_id", F.array_join(F.array_sort("shared_operators"), "|").alias("shared"), (F.size("shared_operators") == 0).alias("disjoint")
    )


@query(
    "find_transfer",
    "SELECT DISTINCT from_gare_id, to_gare_id, round(dist_m, 3) AS dist_m, boundary FROM {fares} JOIN {transfers} ON a_id = least(from_gare_id, to_gare_id) AND b_id = greatest(from_gare_id, to_gare_id) WHERE from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL",
)
def _(x):
    pairs = x.fares.where("from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL").select("from_gare_id", "to_gare_id").distinct()
    t = places.find_transfer(pairs, transfers(x))
    return t.select("from_gare_id", "to_gare_id", r("dist_m", 3), (F.col("transfer_type") == "boundary").alias("boundary"))


@query(
    "cluster_summary",
    """SELECT (SELECT count(*) FROM {placed}) AS n_gates, count(*) AS n_points, count(*) FILTER (c > 1) AS n_shared_points,
    (SELECT count(*) FROM {transfers} WHERE boundary) AS n_boundary, (SELECT count(*) FROM {transfers} WHERE NOT boundary) AS n_exit_reentry
  FROM (SELECT count(*) AS c FROM {placed} GROUP BY lat, lon)""",
)
def _(x):
    from octroi.operators.summaries import cluster_summary

    return cluster_summary(x.gates)


view(
    "aliases",
    "SELECT a.gare_id, b.gare_id AS alias_id FROM {placed} a JOIN {placed} b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 500 AND (a.gare_id = b.gare_id OR a.primary_route = '' OR b.primary_route = '' OR a.primary_route = b.primary_route)",
)


def aliases(x):
    return places.colocated_aliases(x.gates)


@query("colocated_aliases", "SELECT * FROM {aliases}")
def _(x):
    return aliases(x)


view("prices", "SELECT from_gare_id, to_gare_id, min(class1) AS price FROM {fares} WHERE from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL GROUP BY ALL")


@query(
    "alias_fare",
    "SELECT p.from_gare_id, p.to_gare_id, max(q.price) AS price FROM {prices} p JOIN {aliases} a ON a.gare_id = p.from_gare_id JOIN {aliases} b ON b.gare_id = p.to_gare_id JOIN {prices} q ON q.from_gare_id = a.alias_id AND q.to_gare_id = b.alias_id GROUP BY ALL",
)
def _(x):
    p = audits.cheapest_fares(x.fares)
    return places.alias_fare(p, x.gates, p)


# --- roads and features ------------------------------------------------------------------------


@query(
    "snap_to_road",
    f"SELECT g.gare_id, round(min({hav('g.lat', 'g.lon', 'p.lat', 'p.lon', 6371000.0)}), 3) AS snap_distance_m FROM {{placed}} g CROSS JOIN {{pois}} p GROUP BY g.gare_id",
)
def _(x):
    s = places.snap_to_road(x.gates, x.pois)
    return s.select("gare_id", r("snap_distance_m", 3))


@query(
    "features_in_radius",
    f"SELECT g.gare_id, count(p.lat) AS n_features, count(p.lat) = 0 AS no_infrastructure FROM {{placed}} g LEFT JOIN {{pois}} p ON abs(p.lat - g.lat) < 0.01 AND {hav('g.lat', 'g.lon', 'p.lat', 'p.lon', 6371000.0)} <= 300 GROUP BY g.gare_id",
)
def _(x):
    return places.features_in_radius(x.gates, x.pois)


@query("poi_fuzzy_match")
def _(x):
    m = places.poi_fuzzy_match(x.gates, x.pois)
    return m.select("gare_id", "poi_name", r("score", 6), "poi_dist_m", "place_found")


_POI_KM = hav("p.lat", "p.lon", "q.lat", "q.lon", 6371000.0)


@query(
    "toll_free_delta",
    f"""SELECT pid, round(default_m, 2) AS default_m, round(free_m, 2) AS free_m, round(free_m - default_m, 2) AS delta_m, free_m - default_m >= 200 AS confirmed FROM (
    SELECT pid, min({_POI_KM}) AS default_m, min({_POI_KM}) FILTER (NOT is_toll) AS free_m
    FROM (SELECT pid, min(lat) AS lat, min(lon) AS lon FROM (SELECT pid FROM {{isolated}} ORDER BY md5(CAST(pid AS VARCHAR)), pid LIMIT 15) JOIN {{points}} USING (pid) JOIN {{gates}} USING (gare_id) GROUP BY pid) p CROSS JOIN {{pois}} q GROUP BY pid)""",
)
def _(x):
    iso = sampled_rows(matrix.isolated_points(x.legs, x.points).select("pid"), ["pid"], 15)
    spots = written(
        x.points.join(iso, "pid").join(x.gates, "gare_id").groupBy("pid").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")),
        "isolated-sample",
    )

    def snap(roads):
        n = nearest_point(spots, roads).select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), "dist_m")
        return spots.join(n, ["lat", "lon"])

    d = places.toll_free_delta(spots.select("pid"), snap(x.pois), snap(x.pois.where("NOT is_toll")))
    return d.select("pid", r("default_m", 2), r("free_m", 2), r("delta_m", 2), "confirmed")


# --- driven lines ------------------------------------------------------------------------------

_VX, _VY = lamb("lat", "lon")
view("vxy", f"SELECT route_id, seq, {_VX} AS x, {_VY} AS y FROM {{vertices}}")
view(
    "segs",
    """SELECT *, coalesce(sum(len) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
    SELECT a.route_id, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS len FROM {vxy} a JOIN {vxy} b ON b.route_id = a.route_id AND b.seq = a.seq + 1)""",
)
view(
    "on_route",
    """SELECT route_id, gare_id, d, along FROM (
    SELECT *, row_number() OVER (PARTITION BY route_id, gare_id ORDER BY d, along) AS rn FROM (
      SELECT route_id, gare_id, start + t * len AS along, round(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)), 3) AS d FROM (
        SELECT s.*, g.gare_id, g.x, g.y, least(1.0, greatest(0.0, ((g.x - x1) * (x2 - x1) + (g.y - y1) * (y2 - y1)) / (len * len))) AS t
        FROM {segs} s JOIN {placed} g ON g.x BETWEEN least(x1, x2) - 300 AND greatest(x1, x2) + 300 AND g.y BETWEEN least(y1, y2) - 300 AND greatest(y1, y2) + 300)) WHERE d <= 300) WHERE rn = 1""",
)


def on_route(x):
    return places.gates_on_route(x.vertices, x.gates)


@query("gates_on_route", "SELECT route_id, gare_id, round(d, 1) AS dist_m, round(along, 0) AS along_m FROM {on_route}")
def _(x):
    return on_route(x).select("route_id", "gare_id", r("dist_m", 1), r("along_m", 0))


view("route_ends", "SELECT route_id, min(route_id * 7 % 50) + 1 AS origin_pid, min(route_id * 13 % 50) + 1 AS destination_pid FROM {vertices} GROUP BY route_id")
view("spots", "SELECT pid, min(lat) AS lat, min(lon) AS lon FROM {points} JOIN {gates} USING (gare_id) GROUP BY pid")


@query(
    "closest_other_gate",
    f"""SELECT e.route_id, round(d, 2) AS closest_m, coalesce(d > 50, TRUE) AS passed FROM {{route_ends}} e LEFT JOIN (
    SELECT v.route_id, min({hav('v.lat', 'v.lon', 's.lat', 's.lon', 6371000.0)}) AS d
    FROM (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM {{vertices}}) v JOIN {{route_ends}} e ON e.route_id = v.route_id
    JOIN {{spots}} s ON abs(s.lat - v.lat) <= 0.01 AND abs(s.lon - v.lon) <= 0.01 AND s.pid <> e.origin_pid AND s.pid <> e.destination_pid
    WHERE (v.seq - 1) % greatest(1, n // 200) = 0 GROUP BY v.route_id) b ON b.route_id = e.route_id""",
)
def _(x):
    ends = x.vertices.select("route_id").distinct().select(
        "route_id", (F.col("route_id") * 7 % 50 + 1).alias("origin_pid"), (F.col("route_id") * 13 % 50 + 1).alias("destination_pid")
    )
    spots = x.points.join(x.gates, "gare_id").groupBy("pid").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    c = places.closest_other_gate(x.vertices, ends, spots)
    return c.select("route_id", r("closest_m", 2), "passed")


# --- anchors -----------------------------------------------------------------------------------

view(
    "outward",
    """SELECT gare_id, direction, ref_id, seq, lat + seq * (0.0005 + (gare_id + ref_id) % 4 * 0.0004) AS lat, lon + seq * 0.0007 AS lon,
    (gare_id + seq * 3 + ref_id * 5 + d) % 7 = 0 AS reachable,
    CASE WHEN (gare_id + seq + ref_id) % 19 = 0 THEN NULL ELSE CAST((gare_id * 31 + seq * 77 + ref_id * 401) % 2600 AS DOUBLE) END AS apron_m,
    CASE WHEN (gare_id + seq + ref_id) % 19 = 0 THEN NULL ELSE CAST((gare_id * 31 + seq * 77 + ref_id * 401) % 2600 AS DOUBLE) / 12.5 END AS apron_s
  FROM (SELECT gare_id, lat, lon, unnest(range(0, 25)) AS seq FROM {gates} JOIN {needed} USING (gare_id) WHERE anchor_needed)
  CROSS JOIN (VALUES ('entry', 0), ('exit', 1)) d(direction, d) CROSS JOIN (VALUES (0), (1), (2)) f(ref_id)""",
)


def needed_gates(x):
    return cleaning.anchor_needed(snap_pairs(x)).where("anchor_needed").select("gare_id")


def outward(x):
    """Lines walked outward from every gate that needs an anchor: two directions, three references."""
    g, s, d, ref = F.col("gare_id"), F.col("seq"), F.col("_d"), F.col("ref_id")
    apron = F.when((g + s + ref) % 19 != 0, ((g * 31 + s * 77 + ref * 401) % 2600).cast("double"))
    return (
        x.gates.join(needed_gates(x), "gare_id")
        .select("gare_id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("seq"))
        .withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("ref_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            "gare_id", F.when(d == 0, "entry").otherwise("exit").alias("direction"), "ref_id", "seq",
            (F.col("lat") + s * (F.lit(0.0005) + (g + ref) % 4 * F.lit(0.0004))).alias("lat"),
            (F.col("lon") + s * F.lit(0.0007)).alias("lon"),
            ((g + s * 3 + ref * 5 + d) % 7 == 0).alias("reachable"),
            apron.alias("apron_m"), (apron / 12.5).alias("apron_s"),
        )
    )


view(
    "walked",
    f"""SELECT * FROM (SELECT *, sum(step) OVER (PARTITION BY gare_id, direction, ref_id ORDER BY seq) AS walked_m FROM (
    SELECT b.*, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371000.0)} AS step FROM {{outward}} a JOIN {{outward}} b
    ON b.gare_id = a.gare_id AND b.direction = a.direction AND b.ref_id = a.ref_id AND b.seq = a.seq + 1 WHERE b.seq <= 100)) WHERE walked_m <= 2000""",
)


def walked(x):
    return anchors.anchor_walk(outward(x))


@query("anchor_walk", "SELECT gare_id, direction, ref_id, seq, round(walked_m, 2) AS walked_m FROM {walked}")
def _(x):
    return walked(x).select("gare_id", "direction", "ref_id", "seq", r("walked_m", 2))


view(
    "anchored",
    """SELECT gare_id, direction, coalesce(arg_min(apron_m, ref_id) FILTER (apron_m <= 500), min(apron_m)) AS apron_m FROM (
    SELECT gare_id, direction, ref_id, arg_min(coalesce(apron_m, -1), seq) AS apron_m FROM {walked} WHERE reachable GROUP BY ALL) WHERE apron_m >= 0 AND apron_m <= 2000 GROUP BY gare_id, direction""",
)


def found_anchors(x):
    o = outward(x)
    walk = anchors.anchor_walk(o).join(
        o.select("gare_id", "direction", "ref_id", "seq", "reachable", "apron_m", "apron_s"), ["gare_id", "direction", "ref_id", "seq"]
    )
    return anchors.find_anchor(walk)


@query("find_anchor", "SELECT gare_id, direction, apron_m AS apron_distance_m, round(apron_m / 12.5, 6) AS apron_duration_s FROM {anchored}")
def _(x):
    return found_anchors(x).select("gare_id", "direction", "apron_distance_m", r("apron_duration_s", 6))


@query(
    "anchor_stats",
    """SELECT n.direction, count(*) AS needed, count(apron_m) AS found, count(*) - count(apron_m) AS gapped, min(apron_m) AS min_m,
    list_extract(list_sort(list(apron_m) FILTER (apron_m IS NOT NULL)), count(apron_m) // 2 + 1) AS median_m, max(apron_m) AS max_m
  FROM (SELECT DISTINCT gare_id, direction FROM {outward}) n LEFT JOIN {anchored} a USING (gare_id, direction) GROUP BY n.direction""",
)
def _(x):
    both = needed_gates(x).select("gare_id", F.explode(F.array(F.lit("entry"), F.lit("exit"))).alias("direction"))
    return anchors.anchor_stats(both, found_anchors(x))


# --- scoring -----------------------------------------------------------------------------------

view(
    "op_ends",
    "SELECT operator, gare_id, bool_or(o) AS is_from, bool_or(NOT o) AS is_to FROM (SELECT operator, from_gare_id AS gare_id, TRUE AS o FROM {fares} UNION ALL SELECT operator, to_gare_id, FALSE FROM {fares}) WHERE gare_id IS NOT NULL GROUP BY ALL",
)
view(
    "roles",
    f"""SELECT g.gare_id, coalesce(bool_or(is_to AND NOT is_from), FALSE) AS sink_only, coalesce(bool_or(is_from AND NOT is_to), FALSE) AS source_only
  FROM (SELECT gare_id, unnest({pipe_list('operators')}) AS operator FROM {{gates}}) g LEFT JOIN {{op_ends}} e ON e.gare_id = g.gare_id AND e.operator = g.operator GROUP BY g.gare_id""",
)


@query("od_roles", "SELECT * FROM {roles}")
def _(x):
    return scoring.od_roles(x.gates, x.fares)


view("dups", "SELECT gare_id FROM (SELECT gare_id, count(*) OVER (PARTITION BY lat, lon) AS n FROM {placed}) WHERE n > 1")


@query("duplicate_coords", "SELECT gare_id FROM {dups}")
def _(x):
    return scoring.duplicate_coords(x.gates)


view(
    "anomaly",
    "SELECT gare_id, list_extract(list_sort(list(ratio)), count(*) // 2 + 1) AS median_ratio FROM (SELECT unnest([from_gare_id, to_gare_id]) AS gare_id, round(measured_km / distance_km, 4) AS ratio FROM {checks}) GROUP BY gare_id",
)


@query("distance_anomaly", "SELECT gare_id, median_ratio, round(abs(median_ratio - 1), 6) AS anomaly FROM {anomaly}")
def _(x):
    a = scoring.distance_anomaly(audits.distance_status(x.fares, x.points, x.legs))
    return a.select("gare_id", "median_ratio", r("anomaly", 6))


_NAME = flag_cases()
view(
    "classified",
    f"""SELECT g.*, d.gare_id IS NOT NULL AS is_duplicate, list_filter([{_NAME}, CASE WHEN sink_only THEN 'OD_SINK_ONLY' END, CASE WHEN source_only THEN 'OD_SOURCE_ONLY' END,
    CASE WHEN match_tier IN ('D', 'E', 'F') THEN 'LOW_CONFIDENCE' END, CASE WHEN match_tier = 'O' THEN 'MANUAL_OVERRIDE' END, CASE WHEN match_agreement = 'conflicted' THEN 'CONFLICTED' END], lambda s: s IS NOT NULL) AS fl
  FROM {{gates}} g LEFT JOIN {{roles}} USING (gare_id) LEFT JOIN {{dups}} d ON d.gare_id = g.gare_id""",
)
view("sig_snap", "SELECT gare_id, gare_id % 3 <> 1 AS snap_toll FROM {gates} WHERE lat IS NOT NULL AND gare_id % 9 <> 5")
view("sig_feat", f"SELECT g.gare_id, count(p.lat) AS n_features FROM {{placed}} g LEFT JOIN {{pois}} p ON abs(p.lat - g.lat) < 0.01 AND {hav('g.lat', 'g.lon', 'p.lat', 'p.lon', 6371000.0)} <= 300 GROUP BY g.gare_id")
view("sig_poi", "SELECT gare_id, gare_id % 4 <> 2 AS place_found FROM {gates} WHERE lat IS NOT NULL AND gare_id % 10 <> 7")


def signals(x):
    g = scoring.classify_gates(x.gates, x.fares)
    return places.signal_merge(
        g,
        {
            "snap": x.spark.sql(VIEWS["sig_snap"], gates=x.gates),
            "features": places.features_in_radius(x.gates, x.pois),
            "poi": x.spark.sql(VIEWS["sig_poi"], gates=x.gates),
        },
    )


@query(
    "signal_merge",
    """SELECT g.gare_id, snap_toll, CASE WHEN s.gare_id IS NULL THEN 'skipped' ELSE '' END AS snap_error, n_features, CASE WHEN f.gare_id IS NULL THEN 'skipped' ELSE '' END AS features_error,
    place_found, CASE WHEN p.gare_id IS NULL THEN 'skipped' ELSE '' END AS poi_error FROM {gates} g LEFT JOIN {sig_snap} s USING (gare_id) LEFT JOIN {sig_feat} f USING (gare_id) LEFT JOIN {sig_poi} p USING (gare_id)""",
)
def _(x):
    return signals(x).select("gare_id", "snap_toll", "snap_error", "n_features", "features_error", "place_found", "poi_error")


_POINTS = "CASE f " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.FLAG_POINTS.items()) + " ELSE 0 END"


@query(
    "gate_score",
    f"""SELECT gare_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 4 THEN 'LIKELY_INVALID' WHEN score >= 2 THEN 'UNCERTAIN' ELSE 'LIKELY_VALID' END AS verdict,
    coalesce(array_to_string(CASE WHEN is_duplicate THEN list_append(sc, 'DUPLICATE_COORD') ELSE sc END, '|'), '') AS flags FROM (
    SELECT *, coalesce(list_sum(list_transform(sc, lambda f: {_POINTS})), 0) AS score FROM (
      SELECT c.gare_id, is_duplicate, list_concat(fl, list_filter([CASE WHEN snap_distance_m > 200 THEN 'SNAP_FAR' END, CASE WHEN NOT snap_toll THEN 'SNAP_NOT_TOLL' END,
        CASE WHEN n_features <= 0 THEN 'OSM_NO_TOLL_INFRA' END, CASE WHEN NOT place_found THEN 'GOOGLE_NO_MATCH' END], lambda s: s IS NOT NULL)) AS sc
      FROM {{classified}} c LEFT JOIN {{sig_snap}} s USING (gare_id) LEFT JOIN {{sig_feat}} f USING (gare_id) LEFT JOIN {{sig_poi}} p USING (gare_id)))""",
)
def _(x):
    return scoring.gate_score(signals(x)).select("gare_id", F.col("score").cast("bigint").alias("score"), "verdict", "flags")


view("route_count", "SELECT count(DISTINCT route_id) AS n FROM {vertices}")
view("route_list", "SELECT CAST(row_number() OVER (ORDER BY route_id) - 1 AS BIGINT) AS k, route_id FROM (SELECT DISTINCT route_id FROM {vertices})")
view(
    "odd",
    "SELECT c.*, (from_gare_id * 31 + to_gare_id) % (SELECT count(*) FROM {customer_routes}) AS route_id FROM {checks} c WHERE abs(round(measured_km / distance_km, 4) - 1) > 0.5",
)
view("customer_routes", "SELECT DISTINCT route_id FROM {vertices}")
view(
    "inter",
    f"""SELECT o.row_id, h.gare_id, h.along, g.canonical_name AS name FROM {{odd}} o JOIN {{on_route}} h ON h.route_id = o.route_id JOIN {{gates}} g ON g.gare_id = h.gare_id
  WHERE list_contains({pipe_list('g.operators')}, o.operator) AND h.gare_id <> o.from_gare_id AND h.gare_id <> o.to_gare_id""",
)
view("last_price", "SELECT operator, from_gare_id, to_gare_id, arg_max(class1, row_id) AS price FROM {fares} WHERE from_gare_id IS NOT NULL AND to_gare_id IS NOT NULL GROUP BY ALL")


@query(
    "route_decompose",
    """SELECT o.row_id, coalesce(i.names, '') AS intermediate_gates, l.leg_fares FROM {odd} o
  LEFT JOIN (SELECT row_id, string_agg(name, '|' ORDER BY along, gare_id) AS names FROM {inter} GROUP BY row_id) i ON i.row_id = o.row_id
  JOIN (SELECT row_id, string_agg(CASE WHEN price IS NULL THEN '' ELSE printf('%.2f', price) END, '|' ORDER BY k, along, c.gare_id) AS leg_fares FROM (
      SELECT row_id, operator, k, along, gare_id, lead(gare_id) OVER (PARTITION BY row_id ORDER BY k, along, gare_id) AS nxt FROM (
        SELECT row_id, operator, 0 AS k, 0.0 AS along, from_gare_id AS gare_id FROM {odd} UNION ALL SELECT row_id, operator, 2, 0.0, to_gare_id FROM {odd}
        UNION ALL SELECT i.row_id, o.operator, 1, i.along, i.gare_id FROM {inter} i JOIN {odd} o ON o.row_id = i.row_id)) c
    LEFT JOIN {last_price} p ON p.operator = c.operator AND p.from_gare_id = c.gare_id AND p.to_gare_id = c.nxt WHERE c.nxt IS NOT NULL GROUP BY row_id) l ON l.row_id = o.row_id""",
)
def _(x):
    s = audits.distance_status(x.fares, x.points, x.legs)
    n = x.vertices.agg(F.count_distinct("route_id")).scalar()
    pair_routes = s.select("row_id", ((F.col("from_gare_id") * 31 + F.col("to_gare_id")) % n).alias("route_id"))
    return scoring.route_decompose(s, pair_routes, on_route(x), x.gates, x.fares)


@query(
    "gate_detail_lookup",
    """SELECT pid, string_agg(CAST(gare_id AS VARCHAR) || ':' || canonical_name || ':' || match_tier, ';' ORDER BY gare_id) AS detail FROM {points} JOIN {gates} USING (gare_id) GROUP BY pid""",
)
def _(x):
    lists = x.points.groupBy("pid").agg(F.array_sort(F.collect_list("gare_id")).alias("gates"))
    d = places.gate_detail_lookup(lists, x.gates, "pid")
    item = F.transform("gate_detail", lambda v: F.concat_ws(":", v["gare_id"].cast("string"), v["name"], v["match_tier"]))
    return d.select("pid", F.array_join(item, ";").alias("detail"))
