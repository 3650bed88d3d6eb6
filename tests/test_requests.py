import heapq
import random

import pytest
from pyspark.sql import functions as F

from octroi.operators.network import DWELL_M, DWELL_S
from octroi.plans import requests as req


def network(rng, gates=30):
    """Moves as rows, by node as (to_node, toll of class 1, seconds, metres); hub 3 can't be reached."""
    out, rows = {}, []
    for _ in range(500):
        a, b, kind = rng.randrange(gates), rng.randrange(gates), rng.choice((1, 4))
        node, to = a * 2 + (rng.randrange(2) if kind == 1 else 0), b * 2 + (kind == 4)
        toll, s, m = (rng.randrange(1, 60) / 4 if kind == 4 else 0.0), float(rng.randrange(50, 3000)), float(rng.randrange(100, 90000))
        if a != b and not any(t == to for t, *_ in out.get(node, ())):
            out.setdefault(node, []).append((to, toll, s, m))
            rows.append((node, to, kind, s, m, [toll, 2 * toll, None, None, None]))
    legs = [(h, g, d, float(rng.randrange(60, 400)), float(rng.randrange(100, 4000))) for h in range(3) for g in range(h, gates, 5) for d in ("entry", "exit")]
    return out, rows, [*legs, (3, 1, "entry", 60.0, 100.0)]


def cheapest(out, legs, origin, target, ways, k):
    cost = lambda toll, m, s: k[0] * toll + k[1] * m + k[2] * s
    heap = [(cost(0.0, m + DWELL_M, s + DWELL_S), g * 2) for h, g, d, s, m in legs if h == origin and d == "entry"]
    leave, seen = {g * 2 + 1: cost(0.0, m, s) for h, g, d, s, m in legs if h == target and d == "exit"}, {}
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if u not in seen:
            seen[u] = d
            for t, toll, s, m in out.get(u, ()):
                heapq.heappush(heap, (d + cost(ways * toll, m, s), t))
    return min((seen[n] + x for n, x in leave.items() if n in seen), default=None)


@pytest.mark.parametrize("reach", [True, False])
def test_routes_over_near_moves_cost_what_a_search_over_all_moves_finds(spark, reach):
    out, rows, legs = network(random.Random(8))
    moves = spark.createDataFrame(rows, "node bigint, to_node bigint, kind int, e_s double, e_m double, tolls array<double>")
    access = spark.createDataFrame(legs, "hub_id bigint, gare_id bigint, direction string, duration_s double, distance_m double")
    classes = spark.createDataFrame([(1, 0.15, 12.0), (2, 0.2, 15.0)], "vehicle_class int, per_km double, per_hour double")
    pairs = [(0, 1, 1, 12), (0, 2, 1, 12), (1, 2, 2, 15), (2, 0, 2, 40), (2, 2, 1, 12)] + ([] if reach else [(1, 3, 1, 12), (3, 0, 1, 12)])
    groups = spark.createDataFrame(pairs, "origin_id bigint, destination_id bigint, vehicle_class int, vot_bucket bigint")
    found = {(r["origin_id"], r["destination_id"], r["vehicle_class"], r["mode"]): r for r in req.route_table(groups, classes, access, moves).collect()}
    wanted = req.targets(groups, req.searches(groups, classes)).join(req.searches(groups, classes), req.SEARCH).collect()
    n = 0
    for w in wanted:
        k = (w["k_toll"], w["k_m"], w["k_s"])
        best = cheapest(out, legs, w["origin_id"], w["destination_id"], w["vehicle_class"], k)
        got = found.get((w["origin_id"], w["destination_id"], w["vehicle_class"], w["mode"]))
        assert (got is None) == (best is None)
        if got is not None:
            assert abs(got["cost"] - best) < 1e-6
            n += 1
    assert n >= 40


def test_dear_moves_are_not_searched(spark):
    rows = [(2, 5, 4, 100.0, 500.0, [3.0, 6.0]), (2, 7, 4, 9000.0, 500.0, [30.0, None]), (2, 8, 1, 50.0, 500.0, [0.0, 0.0]), (2, 10, 1, 500.0, 500.0, [0.0, 0.0])]
    moves = spark.createDataFrame(rows, "node bigint, to_node bigint, kind int, e_s double, e_m double, tolls array<double>")
    inf = float("inf")
    near = req.near_moves(moves, {(1, 0.0, 0.0, 1.0): (200.0, 60.0), (1, 1.0, 0.0, 0.0): (3.0, -1.0), (2, 0.0, 0.0, 1.0): (inf, inf)})
    got = sorted((r["vehicle_class"], r["to_node"], r["toll"]) for r in near.select("vehicle_class", "to_node", F.col("toll")).collect())
    assert got == [(1, 5, 3.0), (1, 8, 0.0), (2, 5, 6.0), (2, 8, 0.0), (2, 10, 0.0)]


def test_tasks_and_rounds_settle_ways_of_equal_cost_alike(spark, monkeypatch):
    rng = random.Random(3)
    rows = {}
    for _ in range(400):
        a, b, kind = rng.randrange(24), rng.randrange(24), rng.choice((1, 4))
        toll = float(rng.randrange(1, 3)) if kind == 4 else 0.0
        rows[a * 2 + (rng.randrange(2) if kind == 1 else 0), b * 2 + (kind == 4)] = (kind, 60.0 * rng.randrange(1, 3), 500.0, [toll, toll + 1, None, None, None])
    moves = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "node bigint, to_node bigint, kind int, e_s double, e_m double, tolls array<double>")
    legs = [(h, g, d, 60.0, 500.0) for h in range(3) for g in range(h, 24, 8) for d in ("entry", "exit")]
    access = spark.createDataFrame(legs, "hub_id bigint, gare_id bigint, direction string, duration_s double, distance_m double")
    classes = spark.createDataFrame([(1, 0.15, 12.0), (2, 0.2, 15.0)], "vehicle_class int, per_km double, per_hour double")
    groups = spark.createDataFrame([(o, d, c, 12) for o in range(3) for d in range(3) for c in (1, 2)], "origin_id bigint, destination_id bigint, vehicle_class int, vot_bucket bigint")
    found = []
    for most in (req.NEAR_MOST, -1):
        monkeypatch.setattr(req, "NEAR_MOST", most)
        found.append(sorted(map(str, req.route_table(groups, classes, access, moves).collect())))
    assert found[0] == found[1] and len(found[0]) == 3 * 3 * 2 * 12
