import math
import random

from pyspark.sql import functions as F

from octroi.operators import sampling, spatial

RADIUS_KM = 6371.0


def km(a, b):
    p, q, x, y = map(math.radians, (a[0], b[0], a[1], b[1]))
    return 2 * RADIUS_KM * math.asin(min(1.0, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2)))


def scattered(rng, n):
    """Points around the globe, at both poles, on the date line and on the equator."""
    edge = [(90.0, 0.0), (-90.0, 12.0), (89.5, 179.9), (0.0, 180.0), (0.0, -180.0), (0.3, -179.8), (-0.2, 179.7), (0.0, 0.0)]
    wide = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    return edge + wide + [(rng.uniform(-3, 3), (rng.uniform(177, 183) + 180) % 360 - 180) for _ in range(n)]


def test_rings_against_every_pair(spark):
    rng = random.Random(5)
    points = scattered(rng, 90)
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "a int, a_lat double, a_lon double")
    right = left.toDF("b", "b_lat", "b_lon")
    for lo, hi, step in ((350.0, 450.0, 0.25), (0.0, 300.0, 1.0), (900.0, 901.0, 0.7), (9_000.0, 11_000.0, 9.0), (19_000.0, 20_100.0, 4.0)):
        got = spatial.ring_join(left, right, lo, hi, step, RADIUS_KM).select("a", "b").collect()
        want = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if lo <= km(p, q) <= hi}
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def first_pairs(spark, rows, size, band):
    digest = {r.i: r.h for r in spark.createDataFrame([(i,) for i, _, _ in rows], "i long").select("i", F.md5(F.col("i").cast("string")).alias("h")).collect()}
    pairs = [(digest[a], digest[b], a, b) for a, *p in rows for b, *q in rows if a < b and None not in (*p, *q) and band[0] <= km(p, q) <= band[1]]
    return {p[2:] for p in sorted(pairs)[:size]}


def test_sampled_pairs_against_every_pair(spark):
    rng = random.Random(8)
    rows = [(i, rng.uniform(43, 50), rng.uniform(-1, 7)) for i in range(1, 401)]
    rows += [(500 + i, 48.85, 2.35) for i in range(150)] + [(900, None, 1.0), (901, 46.0, None)]
    places = spark.createDataFrame(rows, "place_id long, lat double, lon double")
    for size, band in ((25, (350.0, 450.0)), (400, (350.0, 450.0)), (5, (1_500.0, 1_600.0)), (10**6, (640.0, 650.0))):
        got = sampling.city_pair_sample(places, size, band).collect()
        assert {(r.a_place_id, r.b_place_id) for r in got} == first_pairs(spark, rows, size, band) and len(got) <= size
    assert sampling.city_pair_sample(places.limit(0)).count() == 0


def test_counts_of_cells_never_exceed_the_pairs(spark):
    rng = random.Random(9)
    rows = [(i, rng.uniform(43, 50), rng.uniform(-1, 7), i % 4) for i in range(1, 301)]
    places = spark.createDataFrame(rows, "place_id long, lat double, lon double, level int")
    found = sampling.sure_pairs(places, 350.0, 450.0, 0.2).first()
    for k in range(4):
        held = [r for r in rows if r[3] >= k]
        true = sum(350 <= km(p[1:3], q[1:3]) <= 450 for p in held for q in held if p[0] < q[0])
        assert 0 < found[f"n{k}"] <= true
