"""Network inputs derived from the star-schema tables, for tests, benches and registered queries.

Each text is plain SQL with `{table}` marks; the same text serves Spark (`spark.sql(text, **frames)`)
and the SQL checker (marks replaced by view names). Row identities are formulas over natural keys,
so no derivation needs a global ordering; legs stay sparse, so nothing is quadratic in gates.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from octroi.session import scratch_path

BASE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")

GATES = """
SELECT CAST(s_suppkey AS BIGINT) + 1 AS gare_id,
  CASE WHEN s_suppkey % 50 = 49 THEN 'Système Ouvert ' || CAST(s_suppkey AS STRING)
       WHEN s_suppkey % 11 = 5 THEN 'Bifurcation ' || CAST(s_suppkey AS STRING)
       WHEN s_suppkey % 13 = 6 THEN 'Bretelle  de sortie ' || CAST(s_suppkey AS STRING)
       WHEN s_suppkey % 17 = 8 THEN 'Barrière ' || CAST(s_suppkey AS STRING)
       WHEN s_suppkey % 19 = 9 THEN 'Limite de concession ' || CAST(s_suppkey AS STRING)
       WHEN s_suppkey % 7 = 3 THEN 'Péage ' || CAST(s_suppkey % 14 AS STRING)
       ELSE s_name END AS canonical_name,
  s_name || '|PEAGE ' || CAST(s_suppkey % 14 AS STRING) AS all_names,
  CASE WHEN s_suppkey % 9 = 4 THEN '' ELSE 'A' || CAST(s_nationkey AS STRING) END AS primary_route,
  'A' || CAST(s_nationkey AS STRING) || '|A' || CAST(s_nationkey % 5 AS STRING) || ';D' || CAST(s_suppkey % 3 AS STRING) AS all_routes,
  'OP' || CAST(s_nationkey % 6 AS STRING)
    || CASE WHEN s_suppkey % 3 = 0 THEN ' | OP' || CAST((s_nationkey + 1) % 6 AS STRING) ELSE '' END AS operators,
  CASE s_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE 'O' END AS match_tier,
  CASE WHEN s_suppkey % 8 = 3 THEN 'conflicted' ELSE 'agreed' END AS match_agreement,
  CAST(s_nationkey AS BIGINT) AS nation_id,
  CASE WHEN s_suppkey % 33 = 32 THEN NULL ELSE CAST(43000000
    + (CAST(floor(s_suppkey / 2) AS BIGINT) * 37037 % 7000000)
    + CASE WHEN s_suppkey % 10 = 3 THEN 600 ELSE 0 END AS DOUBLE) / 1000000 END AS lat,
  CASE WHEN s_suppkey % 33 = 32 THEN NULL ELSE CAST(1000000
    + (CAST(floor(s_suppkey / 2) AS BIGINT) * 61613 % 5000000) AS DOUBLE) / 1000000 END AS lon,
  CASE WHEN s_suppkey % 33 = 32 THEN NULL ELSE CAST(s_suppkey * 37 % 230 AS DOUBLE) END AS snap_distance_m
FROM {supplier}
"""

# Every line gives a pair. Every 50th gate is a sink only, so its lines start at the gate before it; pairs whose
# ids add up to a multiple of four are sold one way only, towards the greater id.
FARE_KEYS = """
SELECT DISTINCT CASE WHEN one_way THEN least(f, t) ELSE f END AS f, CASE WHEN one_way THEN greatest(f, t) ELSE t END AS t
FROM (SELECT f, t, (f + t) % 4 = 0 AND t % 50 <> 0 AS one_way FROM (
  SELECT CAST(l_suppkey AS BIGINT) + CASE WHEN l_suppkey % 50 = 49 THEN 0 ELSE 1 END AS f,
    CAST(l_partkey % (SELECT count(*) FROM {supplier}) + 1 AS BIGINT) AS t
  FROM {lineitem}))
"""

BASE_FARES = """
SELECT (b.f * 1000000000 + b.t) * 2 AS row_id,
  CASE WHEN (b.f * 3 + b.t) % 97 = 0 THEN NULL ELSE b.f END AS from_gare_id,
  CASE WHEN (b.f + b.t * 5) % 101 = 0 THEN NULL ELSE b.t END AS to_gare_id,
  'OP' || CAST((b.f + b.t) % 6 AS STRING) AS operator,
  CASE WHEN (b.f + b.t) % 3 = 0 THEN split_part(g1.all_names, '|', 1) ELSE g1.canonical_name END AS from_gare,
  CASE WHEN (b.f + b.t * 5) % 505 = 0 THEN 'Inconnu' WHEN (b.f + b.t) % 3 = 1 THEN split_part(g2.all_names, '|', 1)
       ELSE g2.canonical_name END AS to_gare,
  CASE WHEN (b.f + b.t) % 6 >= 4 THEN NULL
       ELSE CAST((b.f * 53 + b.t * 29) % 4000 + 5 AS DOUBLE) / 10 END AS distance_km,
  '00:00' AS start_time,
  CASE WHEN (b.f + b.t) % 29 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((least(b.f, b.t) * 31
    + greatest(b.f, b.t) * 17) % 9000 + 100
    + CASE WHEN (b.f * 13 + b.t) % 103 = 0 THEN 20000 ELSE 0 END AS DOUBLE) / 100 END AS class1,
  CASE WHEN (b.f + b.t) % 37 <> 0 THEN 0 WHEN (b.f + b.t) % 29 = 0 THEN 1 WHEN (b.f + b.t) % 74 = 0 THEN 2 ELSE 3 END AS second_band
FROM {fare_keys} b JOIN {gates} g1 ON g1.gare_id = b.f JOIN {gates} g2 ON g2.gare_id = b.t
"""

# Some pairs are sold in two time bands: a second row with the same key and another price.
FARES = """
SELECT row_id, from_gare_id, to_gare_id, operator, from_gare, to_gare, distance_km, start_time, class1 FROM {base_fares}
UNION ALL
SELECT row_id + 1 AS row_id, from_gare_id, to_gare_id, operator, from_gare, to_gare, distance_km, '18:00' AS start_time,
  class1 + CASE second_band WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(-30 AS DOUBLE) / 100 ELSE CAST(50 AS DOUBLE) / 100 END AS class1
FROM {base_fares} WHERE second_band > 0
"""

POINTS = """
SELECT gare_id, min(gare_id) OVER (PARTITION BY lat, lon) AS pid FROM {gates} WHERE lat IS NOT NULL
"""

LEGS = """
SELECT from_pid, to_pid,
  CASE WHEN (from_pid * 5 + to_pid * 3) % 41 = 0 THEN NULL
    ELSE CAST((from_pid * 71 + to_pid * 43) % 8000 * 60 + 900 AS DOUBLE) / 10 END AS tolled_s,
  CASE WHEN (from_pid * 5 + to_pid * 3) % 41 = 0 THEN NULL
    ELSE CAST((from_pid * 71 + to_pid * 43) % 8000 * 100 + 1500 AS DOUBLE) END AS tolled_m,
  CASE WHEN from_pid % 40 = 1 OR (from_pid * 7 + to_pid) % 13 = 0 THEN NULL
    ELSE CAST((from_pid * 67 + to_pid * 41) % 8000 * 90 + 1500 AS DOUBLE) / 10 END AS free_s,
  CASE WHEN from_pid % 40 = 1 OR (from_pid * 7 + to_pid) % 13 = 0 THEN NULL
    ELSE CAST((from_pid * 67 + to_pid * 41) % 8000 * 110 + 1800 AS DOUBLE) END AS free_m
FROM (
  SELECT a.pid AS from_pid, b.pid AS to_pid FROM {fare_keys} k
    JOIN {points} a ON a.gare_id = k.f JOIN {points} b ON b.gare_id = k.t WHERE a.pid <> b.pid
  UNION
  SELECT b.pid AS from_pid, a.pid AS to_pid FROM {fare_keys} k
    JOIN {points} a ON a.gare_id = k.f JOIN {points} b ON b.gare_id = k.t WHERE a.pid <> b.pid
)
"""

POIS = """
SELECT CAST(p_partkey AS BIGINT) AS poi_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'PEAGE ' || CAST(p_partkey % 14 AS STRING) ELSE p_name END AS poi_name,
  p_type AS poi_type, p_partkey % 5 = 1 AS is_toll, 20 + p_partkey % 7 * 10 AS speed_kmh,
  CAST(43000000 + (p_partkey % (SELECT count(*) FROM {supplier})) * 37037 % 7000000 + p_partkey % 5 * 900 AS DOUBLE) / 1000000 AS lat,
  CAST(1000000 + (p_partkey % (SELECT count(*) FROM {supplier})) * 61613 % 5000000 AS DOUBLE) / 1000000 AS lon
FROM {part}
"""

PLACES = """
SELECT CAST(c_custkey AS BIGINT) AS place_id, c_name AS place_name, CAST(c_nationkey AS BIGINT) AS nation_id,
  CAST(43000000 + c_custkey * 91193 % 7000000 AS DOUBLE) / 1000000 AS lat,
  CAST(1000000 + c_custkey * 47711 % 5000000 AS DOUBLE) / 1000000 AS lon
FROM {customer}
"""

# Depots where requests begin and end: a few, and one more for every five hundred suppliers.
HUB_COUNT = "SELECT 4 + CAST(floor(count(*) / 500.0) AS BIGINT) AS n FROM {supplier}"
HUBS = """
SELECT hub_id, 'DEPOT ' || CAST(hub_id AS STRING) AS hub_name,
  CAST(4300000 + hub_id * 29119 % 700000 AS DOUBLE) / 100000 AS lat,
  CAST(100000 + hub_id * 14771 % 500000 AS DOUBLE) / 100000 AS lon
FROM (SELECT DISTINCT CAST(c_custkey % (SELECT n FROM {hub_count}) AS BIGINT) AS hub_id FROM {customer})
"""

# Every order is a request of its customer's depot, in any of the five classes.
REQUESTS = """
SELECT CAST(o_orderkey AS BIGINT) AS request_id, CAST(o_custkey % (SELECT n FROM {hub_count}) AS BIGINT) AS origin_id,
  CAST((o_custkey * 3 + o_orderkey % 4 * 7) % (SELECT n FROM {hub_count}) AS BIGINT) AS destination_id,
  CAST(1 + o_orderkey % 5 AS INT) AS vehicle_class,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(25 + o_orderkey % 2 * 40 AS DOUBLE) / 2 END AS vot
FROM {orders}
"""

# A gate is reached from two depots.
HUB_GATES = """
SELECT CAST(gare_id % (SELECT n FROM {hub_count}) AS BIGINT) AS hub_id, gare_id FROM {gates} WHERE lat IS NOT NULL
UNION SELECT CAST((gare_id * 7 + 3) % (SELECT n FROM {hub_count}) AS BIGINT) AS hub_id, gare_id FROM {gates} WHERE lat IS NOT NULL
"""
_ACCESS_SIDE = """
SELECT hub_id, gare_id, '%s' AS direction,
  CASE WHEN (gare_id * 3 + hub_id) %% 11 = 0 THEN NULL
    ELSE CAST((gare_id * 97 + hub_id * 31 + %d) %% 5000 * 10 + 600 AS DOUBLE) / 10 END AS duration_s,
  CASE WHEN (gare_id * 3 + hub_id) %% 11 = 0 THEN NULL
    ELSE CAST((gare_id * 89 + hub_id * 37 + %d) %% 5000 * 20 + 900 AS DOUBLE) END AS distance_m
FROM {hub_gates}
"""
ACCESS = _ACCESS_SIDE % ("entry", 17, 19) + "UNION ALL" + _ACCESS_SIDE % ("exit", 34, 38)

_ANCHOR_SIDE = """
SELECT gare_id, '%s' AS direction, lat + %s AS anchor_lat, lon - %s AS anchor_lon,
  CAST((gare_id * 61 + %d) %% 900 AS DOUBLE) AS apron_distance_m,
  CAST((gare_id * 61 + %d) %% 900 AS DOUBLE) / 10 AS apron_duration_s
FROM {gates} WHERE lat IS NOT NULL AND (gare_id + %d) %% 4 = 0
"""
ANCHORS = (
    _ANCHOR_SIDE % ("entry", "0.0005", "0.0005", 7, 7, 1)
    + "UNION ALL"
    + _ANCHOR_SIDE % ("exit", "0.001", "0.001", 14, 14, 2)
)

# Vertices of driven lines. `seq` is dense per route; the checker numbers rows with one window,
# Spark with the sliced row number (see `Inputs.vertices`).
VERTICES = """
SELECT route_id, seq, event_id, is_toll, (43000000 + (k * 37037) % 7000000 + off) / CAST(1000000 AS DOUBLE) AS lat,
  (1000000 + (k * 61613) % 5000000) / CAST(1000000 AS DOUBLE) AS lon
FROM (
  SELECT route_id, seq, event_id, is_toll,
    (route_id * 11 + seq) % CAST(ceil((SELECT count(*) FROM {supplier}) / 2) AS BIGINT) AS k,
    CASE WHEN event_id % 9 = 4 THEN 900000 ELSE event_id % 7 * 300 END AS off
  FROM {numbered_events})
"""
NUMBERED_EVENTS = """
SELECT CAST(user_id AS BIGINT) AS route_id, CAST(event_id AS BIGINT) AS event_id, event_type = 'purchase' AS is_toll,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq
FROM {events}
"""

TEXTS = {
    "gates": GATES, "fare_keys": FARE_KEYS, "base_fares": BASE_FARES, "fares": FARES, "points": POINTS, "legs": LEGS, "pois": POIS,
    "places": PLACES, "hub_count": HUB_COUNT, "hubs": HUBS, "requests": REQUESTS, "hub_gates": HUB_GATES, "access": ACCESS, "anchors": ANCHORS,
    "numbered_events": NUMBERED_EVENTS, "vertices": VERTICES,
}

_MARK = re.compile(r"\{(\w+)\}")


def marks(text: str) -> list[str]:
    return list(dict.fromkeys(_MARK.findall(text)))


# Tables every query leans on are written once per session and folder, like tables at rest.
AT_REST = ("fare_keys", "fares", "points", "legs", "vertices")
_WRITTEN: dict[tuple[str, str, str], str] = {}


class Inputs:
    """Lazily built frames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir.rstrip("/"), {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._at_rest(name) if name in AT_REST else self._derive(name)
        return self._made[name]

    def _at_rest(self, name: str) -> DataFrame:
        return self.stored(name, lambda: self._derive(name))

    def stored(self, name: str, build) -> DataFrame:
        """A derived table several queries read: built and written once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            path = scratch_path(self.spark, name)
            build().write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def _derive(self, name: str) -> DataFrame:
        if name == "points":
            return self._points()
        if name == "numbered_events":
            return self._numbered_events()
        if name in TEXTS:
            return self.spark.sql(TEXTS[name], **{m: self.table(m) for m in marks(TEXTS[name])})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _points(self) -> DataFrame:
        from octroi.operators.matrix import gate_points

        return gate_points(self.table("gates"))

    def _numbered_events(self) -> DataFrame:
        from pyspark.sql import functions as F

        from octroi.operators.ranking import row_positions

        events = self.table("events").select(
            F.col("user_id").cast("bigint").alias("route_id"),
            F.col("event_id").cast("bigint").alias("event_id"),
            (F.col("event_type") == "purchase").alias("is_toll"),
        )
        slices = F.floor(F.col("event_id") / F.lit(65536))
        return row_positions(events, ["route_id"], ["event_id"], slices, "seq")

    @cached_property
    def gates(self) -> DataFrame:
        return self.table("gates")

    @cached_property
    def fares(self) -> DataFrame:
        return self.table("fares")

    @cached_property
    def legs(self) -> DataFrame:
        return self.table("legs")

    @cached_property
    def points(self) -> DataFrame:
        return self.table("points")

    @cached_property
    def pois(self) -> DataFrame:
        return self.table("pois")

    @cached_property
    def places(self) -> DataFrame:
        return self.table("places")

    @cached_property
    def hubs(self) -> DataFrame:
        return self.table("hubs")

    @cached_property
    def requests(self) -> DataFrame:
        return self.table("requests")

    @cached_property
    def access(self) -> DataFrame:
        return self.table("access")

    @cached_property
    def anchors(self) -> DataFrame:
        return self.table("anchors")

    @cached_property
    def vertices(self) -> DataFrame:
        return self.table("vertices")


def checker_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Body with `{name}` marks -> one SQL text whose WITH clause defines every marked view."""
    texts = {**TEXTS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for m in marks(text):
            if m in texts and m not in order:
                visit(texts[m])
                if m not in order:
                    order.append(m)

    visit(body)

    def fill(text: str) -> str:
        return _MARK.sub(lambda m: f"sv_{m[1]}" if m[1] in texts else m[1], text)

    def cte(n: str) -> str:
        text = fill(texts[n]).strip()
        if text.startswith("USING KEY"):  # a recursive view that keeps one row a key: its columns and keys stand in its first line
            head, text = text.split("\n", 1)
            columns, keys = re.fullmatch(r"USING KEY (.+) OF (.+)", head).group(2, 1)
            return f"sv_{n}({columns}) USING KEY ({keys}) AS ({text})"
        own = re.search(rf"\bsv_{n}\b", text)  # a view that names itself is recursive
        return f"sv_{n} AS {'' if own else 'MATERIALIZED '}({text})"

    head = f"WITH RECURSIVE {', '.join(cte(n) for n in order)}\n" if order else ""
    return head + fill(body).strip()
