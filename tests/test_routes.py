import heapq
import random

from pyspark.sql import functions as F

from octroi.functions import paths, pricing
from octroi.operators import cleaning, network, sections
from octroi.operators.relax import relax, walk, ways_back


def dijkstra(edges, start):
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in edges.get(u, ()):
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def test_relax_matches_dijkstra_in_every_lane_with_salted_hot_node(spark):
    rng = random.Random(11)
    raw = {(rng.randrange(40), rng.randrange(40)): (float(rng.randrange(0, 20)), float(rng.randrange(0, 3))) for _ in range(300)}
    raw |= {(0, v): (30.0 + v, 1.0) for v in range(1, 40)}
    moves = spark.createDataFrame([(a, b, 0, *w) for (a, b), w in raw.items()], "node bigint, to_node bigint, kind int, u double, v double")
    seeds = spark.createDataFrame([(s, s, 0.0, 0.0 if s else None) for s in (0, 7)], "src bigint, node bigint, c0 double, c1 double")
    increment = lambda k: F.col("uv"[k])
    state = relax(seeds, moves, ["src"], increment, lanes=2, fan_rows=5)
    graphs = [{}, {}]
    for (a, b), w in raw.items():
        for k in (0, 1):
            graphs[k].setdefault(a, []).append((b, w[k]))
    got = {(r["src"], r["node"], k): r[f"c{k}"] for r in state.collect() for k in (0, 1) if r[f"c{k}"] is not None}
    want = {(s, n, k): d for s, k in ((0, 0), (7, 0), (7, 1)) for n, d in dijkstra(graphs[k], s).items()}
    assert got == want
    # the way of fewest moves among the cheapest ones, then of the least starts, last move first
    heads = state.selectExpr("src", "node", "posexplode(array(c0, c1)) as (lane, c)").where("c is not null").drop("c")
    links = ways_back(heads, state, moves, ["src"], increment, lanes=2, carry={"u": F.col("u")})
    for r in walk(heads, links, ["src"], ("u",)).collect():
        graph, cost = graphs[r["lane"]], lambda n, r=r: want.get((r["src"], n, r["lane"]))
        hops = fewest_moves(graph, cost, r["src"])
        nodes = [v["node"] for v in r["path"]]
        assert nodes[0] == r["src"] and nodes[-1] == r["node"] and len(nodes) - 1 == hops[r["node"]]
        for x, y in zip(nodes, nodes[1:]):
            fit = [p for p in graph if hops.get(p) == hops[y] - 1 and any(t == y and cost(p) + w == cost(y) for t, w in graph[p])]
            assert x == min(fit)
        assert [v["u"] for v in r["path"]] == [None, *(raw[p][0] for p in zip(nodes, nodes[1:]))]


def fewest_moves(graph, cost, start):
    """Moves of the shortest way by moves among those that have the least cost."""
    hops, level = {start: 0}, [start]
    while level:
        further = [t for p in level for t, w in graph.get(p, ()) if cost(p) + w == cost(t) and t not in hops]
        hops |= {t: hops[level[0]] + 1 for t in further}
        level = sorted(set(further))
    return hops


def one(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first()["v"]


def test_chain_skips_synthetic_and_repeats(spark):
    # entry at 5, toll to 9, free to 7, toll to 9
    codes = [5 * 8 + 5, 9 * 8 + 4, 7 * 8 + 1, 9 * 8 + 4]
    assert one(spark, paths.gate_chain("p"), "p array<bigint>", (codes,)) == [5, 9, 7, 9]
    assert one(spark, paths.toll_hops("p"), "p array<bigint>", (codes,)) == 2
    legs = one(spark, paths.toll_legs("p"), "p array<bigint>", (codes,))
    assert [(v["from_gare_id"], v["to_gare_id"]) for v in legs] == [(5, 9), (7, 9)]


def test_leg_indices_move_forward_only(spark):
    schema = "c array<bigint>, e array<bigint>"
    assert one(spark, paths.leg_indices("c", "e"), schema, ([5, 9, 7, 9], [9, 9])) == [1, 3]
    assert one(spark, paths.leg_indices("c", "e"), schema, ([5], [5, 5])) == [0]
    assert one(spark, paths.leg_indices("c", "e"), schema, ([5, 9], [4, 9])) == [1]


def test_same_operator_split(spark):
    schema = "o array<string>"
    assert one(spark, paths.same_operator_split("o"), schema, (["A", "B", "A"],))
    assert not one(spark, paths.same_operator_split("o"), schema, (["A", None, None, "B"],))


def test_costs_and_thresholds(spark):
    schema = "a double, b double, t double"
    cost = pricing.generalised_cost(F.lit(10.0), F.lit(100_000.0), F.lit(3600.0), F.lit(0.15), F.lit(12.0))
    assert one(spark, cost, schema, (0.0, 0.0, 0.0)) == 10.0 + 15.0 + 12.0
    grid = one(spark, pricing.vot_grid(), schema, (0.0, 0.0, 0.0))
    assert len(grid) == 10 and abs(grid[0] - 1) < 1e-12 and abs(grid[-1] - 100) < 1e-9 and grid == sorted(set(grid))
    single = one(spark, pricing.vot_grid(30, 30, 1), schema, (0.0, 0.0, 0.0))
    assert len(single) == 1 and abs(single[0] - 30) < 1e-9
    rate = pricing.eur_per_hour_saved(F.col("a"), F.col("b"))
    assert one(spark, rate, schema, (5.0, 30.0, 0.0)) == 10.0
    assert one(spark, rate, schema, (5.0, 0.0, 0.0)) == float("inf")
    assert one(spark, rate, schema, (-5.0, 0.0, 0.0)) is None
    assert one(spark, pricing.worthwhile(rate, F.col("t")), schema, (-5.0, 0.0, 1.0)) is False
    floor = pricing.detour_floor(F.col("a"), F.col("b"))
    assert [one(spark, floor, schema, v) for v in ((10.0, 0.0, 0.0), (0.0, 5.0, 0.0), (9.9, 4.9, 0.0))] == [True, True, False]
    assert [one(spark, pricing.vot_bucket(F.col("a")), schema, (v, 0.0, 0.0)) for v in (12.5, 13.5)] == [12, 14]


def hop_chains(i, j, fares, gaps):
    """Every way from gate i to gate j: fares one after the other, and steps (None) over gaps that no fare spans."""
    if i == j:
        yield []
    for p, q in fares:
        if p == i and q <= j:
            yield from ([(p, q), *rest] for rest in hop_chains(q, j, fares, gaps))
    if i in gaps and i < j:
        yield from ([None, *rest] for rest in hop_chains(i + 1, j, fares, gaps))


def brute_prices(n, fares):
    """Cheapest chain of each pair that neither begins nor ends at a gap, with a fare wherever one fits a stretch between gaps."""

    def allowed(way):
        marks = [-1, *(k for k, hop in enumerate(way) if hop is None), len(way)]
        stretches = [way[a + 1 : b] for a, b in zip(marks, marks[1:])]
        return all(len(s) < 2 or (s[0][0], s[-1][1]) not in fares for s in stretches)

    gaps = {k for k in range(n - 1) if all(q <= k or p > k for p, q in fares)}
    out = {}
    for j in range(n):
        for i in set(range(j)) - gaps:
            ways = [] if j - 1 in gaps else [w for w in hop_chains(i, j, fares, gaps) if allowed(w)]
            if ways:
                price = min(sum(fares[hop] for hop in w if hop) for w in ways)
                if price or None not in ways[0]:
                    out[i, j] = price
    return out


def test_chain_prices_against_brute_force(spark):
    rng = random.Random(2)
    cases = []
    for no in range(12):
        n = rng.randrange(3, 9)
        fares = {(i, j): float(rng.randrange(0, 30)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.35}
        cases.append((no, n, fares))
    sec = [(1, no, i, no * 100 + i, i * 1000.0, n) for no, n, _ in cases for i in range(n)]
    links = [(1, no, i, j, p) for no, _, fares in cases for (i, j), p in fares.items()]
    pairs = [(1, no, i, j) for no, n, _ in cases for i in range(n) for j in range(i + 1, n)]
    got = sections.chain_prices(
        spark.createDataFrame(sec, "route_id bigint, section_no bigint, i bigint, gare_id bigint, along_m double, n bigint"),
        spark.createDataFrame(links, "route_id bigint, section_no bigint, i bigint, j bigint, price double"),
        spark.createDataFrame(pairs, "route_id bigint, section_no bigint, i bigint, j bigint"),
    )
    have = {(r["section_no"], r["i"], r["j"]): round(r["price"], 6) for r in got.collect()}
    want = {(no, *k): round(v, 6) for no, n, fares in cases for k, v in brute_prices(n, fares).items()}
    assert have == want


def test_static_costs_group_no_toll_free_edges_and_equal_the_grouping_of_all(spark):
    n = 8
    points = spark.createDataFrame([(g, (g + 1) // 2) for g in range(1, n + 1)], "gare_id long, pid long")
    active = points.select("gare_id")
    legs = [(a, b, None if (a + b) % 3 == 0 else a * 10.0 + b, a * 100.0 + b, a * 20.0 + b, a * 200.0 + b) for a in range(1, 5) for b in range(1, 5) if a != b]
    matrix = spark.createDataFrame(legs, "from_pid long, to_pid long, tolled_s double, tolled_m double, free_s double, free_m double")
    rows = [(r, 1 + r % n, 1 + r * 3 % n, "A", "x", "y", 5.0, 1.0 + r) for r in range(40)]
    fares = cleaning.class_prices(spark.createDataFrame(rows, "row_id long, from_gare_id long, to_gare_id long, operator string, from_gare string, to_gare string, distance_km double, class1 double"))
    met = [(1, 3, "exit_reentry", 180.0, 500.0), (2, 5, "boundary", 0.0, 0.0), (1, 2, "exit_reentry", 180.0, 500.0)]
    transfers = spark.createDataFrame(met, "a_id long, b_id long, transfer_type string, dwell_s double, dwell_m double")
    got = network.static_costs(fares, active, points, matrix, transfers)
    want = network.edge_costs(network.static_edges(active, fares, active, points, matrix, transfers))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == want.columns
    assert got.where("edge_type = 'exit_reentry'").count() == 8
