import itertools
import random

from octroi.operators import sections


def brute_search(route, cands, legs, inner, vot, allow_skip):
    """Every choice of at most one candidate a section, in order: (cost, toll, seconds, choices) of the best."""
    _, origin, destination, n = route
    options = [[c for c in cands if c[:2] == (route[0], k)] + ([None] if allow_skip else []) for k in range(n)]
    found = []
    for way in itertools.product(*options):
        at, toll, seconds = origin, 0.0, 0.0
        for c in filter(None, way):
            _, _, a, b, price = c
            leg = 0.0 if at == a else legs.get((at, a))
            ride = 0.0 if a == b else inner.get((a, b))
            if leg is None or ride is None:
                break
            at, toll, seconds = b, toll + price, seconds + leg + ride
        else:
            leg = 0.0 if at == destination else legs.get((at, destination))
            if leg is not None:
                found.append((round(toll + vot * (seconds + leg) / 3600, 6), toll, seconds + leg, sum(c is not None for c in way)))
    return min(found, default=None)


def test_section_search_against_every_choice(spark):
    rng = random.Random(21)
    routes = [(r, rng.randrange(12), rng.randrange(12), n) for r, n in enumerate((0, 1, 2, 4, 3, 4, 2, 5))]
    cands = [(r, k, rng.randrange(12), rng.randrange(12), float(rng.randrange(0, 90)) / 4) for r, _, _, n in routes for k in range(n) for _ in range(rng.randrange(1, 4))]
    cands = [c for c in cands if c[:2] != (3, 2) and not (c[0] == 7 and c[1] >= 3)]  # sections that nothing prices, also the last ones of all
    legs = {(a, b): float(rng.randrange(600, 9000)) for a in range(12) for b in range(12) if a != b and rng.random() < 0.8}
    inner = {(a, b): float(rng.randrange(300, 5000)) for a in range(12) for b in range(12) if a != b and rng.random() < 0.9}
    every = sorted({*legs, *inner})
    frames = (
        spark.createDataFrame([r[:3] for r in routes], "route_id long, origin_pid long, destination_pid long"),
        spark.createDataFrame([(r, k, a, b, a, b, p) for r, k, a, b, p in cands], "route_id long, section_no long, entry_pid long, exit_pid long, entry_id long, exit_id long, price double"),
        spark.createDataFrame([(*p, legs.get(p), inner.get(p)) for p in every], "from_pid long, to_pid long, free_s double, tolled_s double"),
        spark.createDataFrame([(r, n) for r, _, _, n in routes if n], "route_id long, n_sections long"),
    )
    for allow_skip, vots in ((True, (5.0, 40.0)), (False, (20.0,))):
        got = sections.section_dp(*frames, vots=vots, allow_skip=allow_skip).collect()
        want = {(r[0], v): brute_search(r, cands, legs, inner, v, allow_skip) for r in routes for v in vots}
        assert {(r.route_id, r.vot): (round(r.cost, 6), r.toll_eur, r.seconds, r.n_choices) for r in got} == {k: w for k, w in want.items() if w}
        for r in got:
            assert len(r.choices) == r.n_choices and abs(sum(c.toll for c in r.choices) - r.toll_eur) < 1e-9


def test_free_road_is_measured_both_ways(spark):
    """A probe beside the line within 300 m, one just beyond it, one that leaves half of the line, and one with a detour."""
    line = [(0.0, 0.0), (4_000.0, 0.0), (8_000.0, 1_000.0)]
    probes = {0: [(x, y + 290.0) for x, y in line], 1: [(x, y + 330.0) for x, y in line], 2: line[:2], 3: [line[0], (2_000.0, 900.0), *line[1:]], 4: line[::-1]}
    schema = "route_id long, section_no long, x1 double, y1 double, x2 double, y2 double, len_m double, start_m double"

    def rows(k, points):
        return [(1, k, *a, *b, ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, 0.0) for a, b in zip(points, points[1:])]

    driven = spark.createDataFrame([r for k in range(6) for r in rows(k, line)], schema)
    probe = spark.createDataFrame([r for k, p in probes.items() for r in rows(k, p)], schema)
    got = sections.untolled_sections(driven, probe)
    assert sorted(r.section_no for r in got.collect()) == [0, 4]
    gates = spark.createDataFrame([(1, k, i, 10 * k + i) for k in range(6) for i in range(2)], "route_id long, section_no long, i long, gare_id long")
    left = sections.drop_untolled(gates, got).collect()
    assert sorted((r.section_no, r.gare_id // 10, r.i) for r in left) == [(n, k, i) for n, k in enumerate((1, 2, 3, 5)) for i in range(2)]


def test_links_by_blocks_against_every_pair(spark, monkeypatch):
    """F1 F2 F6 F14 F23: no place meets all fares of its gate; parts, slices and batches of pairs are small here, so all of them are many."""
    rng = random.Random(5)
    for name, size in (("PART_CLASSES", 4), ("BLOCK_PLACES", 20), ("PAIRS_AT_ONCE", 7)):
        monkeypatch.setattr(sections, name, size)
    spots = {g: (43.0 + 0.1 * (g % 13), 3.0) for g in range(1, 31)}
    roads = {g: ("", "A1", "A2")[g % 3] for g in spots}
    fares = {(a, b): float(rng.randrange(1, 99)) for a in spots for b in spots if a != b and rng.random() < 0.2}
    places = [(r, k, i, g) for r in range(3) for k in range(2) for i, g in enumerate(rng.sample(sorted(spots), 11))]
    alias = lambda a, b: spots[a] == spots[b] and (a == b or "" in (roads[a], roads[b]) or roads[a] == roads[b])
    want = {}
    for r, k, i, g in places:
        for _, _, j, h in (p for p in places if p[:2] == (r, k) and p[2] > i):
            prices = [p for (a, b), p in fares.items() if alias(g, a) and alias(h, b)]
            if prices:
                want[r, k, i, j] = max(prices)
    got = sections.section_links(
        spark.createDataFrame(places, "route_id long, section_no long, i long, gare_id long"),
        spark.createDataFrame([(g, *spots[g], roads[g]) for g in spots], "gare_id long, lat double, lon double, primary_route string"),
        spark.createDataFrame([(*k, p) for k, p in fares.items()], "from_gare_id long, to_gare_id long, price double"),
    ).collect()
    assert len(got) == len(want) and {(r.route_id, r.section_no, r.i, r.j): r.price for r in got} == want


def test_chains_of_a_section_and_of_one_too_large_for_a_task(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(sections, "STARTS_AT_ONCE", 2)
    links = {(1, k, i, j): float(rng.randrange(1, 50)) for k in range(4) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.25}
    wanted = [(1, k, a, b) for k in range(5) for a in range(0, 12, 2) for b in range(a + 1, 12) if (1, k, a, b) not in links]
    cost = {(k, a, a): 0.0 for k in range(5) for a in range(12)}
    for _, k, i, j in sorted(links):
        for a in range(i + 1):
            cost[k, a, j] = min(cost.get((k, a, j), 1e9), cost.get((k, a, i), 1e9) + links[1, k, i, j])
    want = {w: cost[w[1:]] for w in wanted if cost.get(w[1:], 1e9) < 1e9}
    frames = (
        spark.createDataFrame(wanted, "route_id long, section_no long, a long, b long"),
        spark.createDataFrame([(*k, p) for k, p in links.items()], "route_id long, section_no long, i long, j long, price double"),
    )
    sizes = sorted(sum(x[1] == k for x in links) for k in range(4))
    for most in (sections.SECTION_LINKS, sizes[1]):
        got = {(r.route_id, r.section_no, r.a, r.b): r.chained for r in sections.cheapest_chains(*frames, most).collect()}
        assert got == want
