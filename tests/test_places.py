import difflib
import math
import random
import statistics

from pyspark.sql import functions as F

from octroi.functions.geo import with_lambert
from octroi.operators import anchors, matrix, places, ranking, sections
from octroi.operators.spatial import near_points, nearest_point

GATES = "gare_id bigint, canonical_name string, operators string, lat double, lon double"


def hav(a, b, c, d, r=6371000.0):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * r * math.asin(min(1.0, math.sqrt(h)))


def test_grid_join_finds_every_pair(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(59.0, 59.2), rng.uniform(-0.3, 0.3)) for _ in range(120)]
    pts += [(rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1)) for _ in range(80)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = {(r[0], r[1], r[2], r[3]) for r in near_points(df, df, 5000.0).collect()}
    want = {(*p, *q) for p in pts for q in pts if hav(*p, *q) <= 5000.0}
    assert got == want


def test_nearest_point_widens_until_found(spark):
    a = spark.createDataFrame([(45.0, 4.0), (10.0, 100.0)], "lat double, lon double")
    b = spark.createDataFrame([(45.001, 4.0), (45.5, 4.0)], "lat double, lon double")
    got = {(r["a_lat"], r["b_lat"]) for r in nearest_point(a, b).collect()}
    assert got == {(45.0, 45.001), (10.0, 45.5)}


def test_lambert_origin(spark):
    r = with_lambert(spark.createDataFrame([(46.5, 3.0)], "lat double, lon double")).first()
    assert abs(r["x"] - 700000.0) < 1e-6 and abs(r["y"] - 6600000.0) < 0.01


def test_transfer_types(spark):
    rows = [(1, "a", "AA", 45.0, 4.0), (2, "b", "BB", 45.0, 4.0), (3, "c", "AA | CC", 45.0, 4.0), (4, "d", "AA", 45.01, 4.0)]
    got = {(r["a_id"], r["b_id"]): (r["transfer_type"], r["dwell_s"], r["dwell_m"]) for r in places.transfer_pairs(spark.createDataFrame(rows, GATES)).collect()}
    assert got == {(1, 2): ("boundary", 0.0, 0.0), (1, 3): ("exit_reentry", 180.0, 500.0), (2, 3): ("boundary", 0.0, 0.0)}


def test_cluster_ids_follow_the_smallest_member(spark):
    rows = [(7, "a", "", 1.0, 1.0), (3, "b", "", 2.0, 2.0), (5, "c", "", 1.0, 1.0), (9, "d", "", None, None)]
    got = [(r["physical_gate_id"], r["gare_ids"]) for r in matrix.physical_clusters(spark.createDataFrame(rows, GATES)).orderBy("pid").collect()]
    assert got == [(1, [3]), (2, [5, 7])]


def test_names_match_like_difflib(spark):
    g = spark.createDataFrame([(1, "Péage de Lyon", "", 45.0, 4.0), (2, "Zzz", "", 46.0, 4.0)], GATES)
    pois = [("peage lyon", 45.0005, 4.0), ("gare", 45.0, 4.0005), ("peage de lyon", 45.1, 4.0)]
    r = {v["gare_id"]: v for v in places.poi_fuzzy_match(g, spark.createDataFrame(pois, "poi_name string, lat double, lon double")).collect()}
    assert r[1]["poi_name"] == "peage lyon" and r[1]["place_found"]
    assert abs(r[1]["score"] - difflib.SequenceMatcher(None, "peage de lyon", "peage lyon").ratio()) < 1e-12
    assert r[2]["poi_name"] is None and not r[2]["place_found"]


def test_closest_gate_ignores_own_ends(spark):
    v = spark.createDataFrame([(1, 1, 45.0, 4.0), (1, 2, 45.001, 4.0)], "route_id bigint, seq bigint, lat double, lon double")
    spots = spark.createDataFrame([(10, 45.0, 4.0), (11, 45.001, 4.0), (12, 45.0004, 4.0)], "pid bigint, lat double, lon double")
    ends = spark.createDataFrame([(1, 10, 11)], "route_id bigint, origin_pid bigint, destination_pid bigint")
    r = places.closest_other_gate(v, ends, spots).first()
    assert r["closest_pid"] == 12 and not r["passed"]
    r = places.closest_other_gate(v, ends, spots.where("pid < 12")).first()
    assert r["closest_pid"] is None and r["closest_m"] is None and r["passed"]


def test_anchor_skips_the_unreachable_vertex(spark):
    walk = [(1, "entry", 0, 1, 45.0, 4.0, False, 60.0, 5.0), (1, "entry", 0, 2, 45.001, 4.0, True, 149.0, 12.5), (1, "entry", 0, 3, 45.002, 4.0, True, 10.0, 1.0)]
    w = spark.createDataFrame(walk, "gare_id bigint, direction string, ref_id int, seq int, lat double, lon double, reachable boolean, apron_m double, apron_s double")
    r = anchors.find_anchor(w).first()
    assert (r["anchor_lat"], r["apron_distance_m"], r["apron_duration_s"]) == (45.001, 149.0, 12.5)


def test_spacing_is_greedy(spark):
    rng = random.Random(5)
    rows = [(k % 3, i, float(rng.randrange(0, 6000))) for k in range(3) for i in range(80)]
    got = sections.along_route_spacing(spark.createDataFrame(rows, "route_id bigint, gare_id bigint, along_m double")).collect()
    want = set()
    for k in range(3):
        last = None
        for along in sorted({a for r, _, a in rows if r == k}):
            if last is None or along - last >= 200:
                want.add((k, along))
                last = along
    assert {(r["route_id"], r["along_m"]) for r in got} == want


def test_order_statistics_match_python_on_a_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot", float(rng.randrange(50))) for _ in range(600)] + [("b", float(rng.randrange(1000))) for _ in range(31)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    med = {r["k"]: r["m"] for r in ranking.medians(df, ["k"], "v", "m").collect()}
    up = {r["k"]: r["u"] for r in ranking.order_statistics(df, ["k"], "v", {"u": ranking.upper_middle()}).collect()}
    for k in ("hot", "b", "c"):
        vals = sorted(v for g, v in rows if g == k)
        assert med[k] == statistics.median(vals) and up[k] == vals[len(vals) // 2]


def test_row_positions_and_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1.0).alias("x"))
    p = ranking.row_positions(df, [], ["v"]).collect()
    assert all(r["pos"] == r["v"] + 1 for r in p)
    t = ranking.running_total(df.withColumn("g", F.lit(1)), ["g"], "v", F.floor(F.col("v") / 64), "x", "before").collect()
    assert all(r["before"] == r["v"] for r in t)


def test_thin_indices_round_half_to_even(spark):
    df = spark.createDataFrame([(n,) for n in (2, 6, 7, 12, 23)], "n bigint")
    for r in df.select("n", sections.thin_indices(F.col("n")).alias("t")).collect():
        n = r["n"]
        want = list(range(n)) if n <= 6 else sorted({round(i * (n - 1) / 5) for i in range(6)})
        assert r["t"] == want
