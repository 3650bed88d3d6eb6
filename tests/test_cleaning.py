

import math
import random

from pyspark.sql import functions as F

from octroi.functions import text
from octroi.operators import audits, cleaning, resolve

GATES = "gare_id bigint, canonical_name string, all_names string, operators string, lat double, lon double"
FARES = "row_id bigint, operator string, from_gare_id bigint, to_gare_id bigint, from_gare string, to_gare string, distance_km double, class1 double"


def zero(spark, gates, row):
    g = spark.createDataFrame(gates, GATES)
    f = spark.createDataFrame([row], FARES)
    r = cleaning.zero_price_disposition(f, g).first()
    return r["disposition"], r["rule"]


def gate(i, ops, lat, lon, name="x"):
    return (i, name, name, ops, lat, lon)


def fare(a="A", b="B", km=None, price=0.0):
    return (1, "AA", 1, 2, a, b, km, price)


def test_operator_boundary_beats_node_name(spark):
    gates = [gate(1, "AA", 45.0, 4.0), gate(2, "BB", 45.02, 4.0)]
    assert zero(spark, gates, fare("Bifurcation X")) == ("free_transfer", "operator_boundary_short_hop")


def test_node_name_at_any_distance(spark):
    gates = [gate(1, "AA", 45.0, 4.0), gate(2, "AA", 48.0, 4.0)]
    assert zero(spark, gates, fare(b="la BIFURCATION nord")) == ("free_section", "structural_node_name")


def test_short_hop_and_far_row(spark):
    gates = [gate(1, "AA", 45.0, 4.0), gate(2, "AA", 45.03, 4.0)]
    assert zero(spark, gates, fare()) == ("free_section", "short_physical_hop")
    gates = [gate(1, "AA", 45.0, 4.0), gate(2, "BB", 46.0, 4.0)]
    assert zero(spark, gates, fare()) == ("drop", "default_no_signal")


def test_stated_distance_when_a_place_is_missing(spark):
    gates = [gate(1, "AA", None, None), gate(2, "AA", 46.0, 4.0)]
    assert zero(spark, gates, fare(km=3.0))[0] == "free_section"
    assert zero(spark, gates, fare(km=None))[0] == "drop"


def match(spark, gates, name, operator="AA", km=None, known=None):
    g = spark.createDataFrame(gates, GATES)
    f = spark.createDataFrame([(1, operator, known, None, "k", name, km, 1.0)], FARES)
    rows = resolve.resolve_blank_endpoints(f, g).where("endpoint = 'to'").collect()
    return rows[0]["matched_gare_id"], rows[0]["rule"]


def test_canonical_beats_alias(spark):
    gates = [(550, "PARIS", "CHATEAU", "AA", 48.0, 2.0), (551, "CHATEAU", "CHATEAU", "AA", 48.0, 2.5)]
    assert match(spark, gates, "Château") == (551, "canonical_name_exact_match")


def test_alias_only_and_unknown(spark):
    gates = [(1, "PARIS", "LUTECE|PARIS", "AA", 48.0, 2.0)]
    assert match(spark, gates, "  lutèce ") == (1, "alias_name_match")
    assert match(spark, gates, "nowhere") == (None, "default_unresolved")


def test_coordinates_break_a_duplicate_name(spark):
    gates = [(1, "DUP", "DUP", "AA", 45.0, 4.0), (2, "DUP", "DUP", "AA", 48.0, 4.0), (9, "K", "K", "AA", 45.5, 4.0)]
    assert match(spark, gates, "dup", km=56.0, known=9) == (1, "coordinate_proximity_disambiguation")


def test_operator_breaks_a_coordinate_tie(spark):
    gates = [(1, "DUP", "DUP", "AA", 45.0, 4.0), (2, "DUP", "DUP", "BB", 45.0, 4.0), (9, "K", "K", "AA", 45.5, 4.0)]
    assert match(spark, gates, "dup", "BB", km=56.0, known=9) == (2, "operator_tag_disambiguation")
    gates[1] = (2, "DUP", "DUP", "AA", 45.0, 4.0)
    assert match(spark, gates, "dup", "AA", km=56.0, known=9) == (None, "default_unresolved")


def test_text_expressions(spark):
    df = spark.createDataFrame([("B | A|  |A", "A1;A2|A1,N7", "Péage  du  Nord ", "1 234,50")], "o string, r string, n string, d string")
    r = df.select(
        text.pipe_set("o").alias("o"), text.route_tokens("r").alias("r"), text.normalise_name("n").alias("n"), text.decimal_comma("d").alias("d")
    ).first()
    assert r["o"] == ["A", "B"] and r["r"] == ["A1", "A2", "N7"] and r["n"] == "PEAGE DU NORD" and r["d"] == 1234.5


def test_asymmetry_counts_self_loop_once_and_first_row_wins(spark):
    rows = [
        (1, "AA", 1, 2, "", "", None, 10.0), (2, "AA", 1, 2, "", "", None, 99.0), (3, "AA", 2, 1, "", "", None, 4.0),
        (4, "AA", 3, 3, "", "", None, 1.0), (5, "AA", 4, 5, "", "", None, 1.0),
    ]
    r = audits.asymmetry_audit(spark.createDataFrame(rows, FARES)).first()
    assert tuple(r) == (2, 1, 1)


def test_symmetric_pairs_is_closed_under_swap(spark):
    p = spark.createDataFrame([(1, 2), (3, 3)], "from_gare_id bigint, to_gare_id bigint")
    once = audits.symmetric_pairs(p)
    assert {tuple(r) for r in once.collect()} == {(1, 2), (2, 1), (3, 3)}
    assert {tuple(r) for r in audits.symmetric_pairs(once).collect()} == {(1, 2), (2, 1), (3, 3)}


def test_unusable_inputs_raise(spark):
    import pytest

    g = spark.createDataFrame([gate(1, "AA", 1.0, 1.0)], GATES)
    f = spark.createDataFrame([fare()], FARES)
    with pytest.raises(RuntimeError):
        audits.require_no_violations(f, g)
    classes = spark.createDataFrame([], "vehicle_class int, per_km double, per_hour double")
    with pytest.raises(RuntimeError):
        cleaning.request_classes(spark.createDataFrame([(1,)], "vehicle_class int"), classes)


def test_error_percentiles_empty_and_monotone(spark):
    assert audits.error_percentiles(spark.createDataFrame([], "error double")).where("n > 0").count() == 0
    rows = [(((i * 37) % 101 - 50) / 10.0,) for i in range(101)]
    r = audits.error_percentiles(spark.createDataFrame(rows, "error double")).first()
    vals = sorted(abs(v[0]) for v in rows)
    pick = lambda p: vals[min(100, int(101 * p / 100))]
    assert [r[c] for c in ("median", "p75", "p90", "p95", "p99", "max")] == [pick(p) for p in (50, 75, 90, 95, 99)] + [vals[-1]]



def km(lat1, lon1, lat2, lon2):
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_distance_rule_against_brute_force_and_without_ordering_candidates(spark, capsys):
    """Many gates of one name, some at one place: the fitting one is found without a window over all pairs."""
    rng = random.Random(5)
    spots = [(round(rng.uniform(43, 50), 2), round(rng.uniform(1, 6), 2)) for _ in range(12)]
    gates = [gate(i, "AA", *spots[rng.randrange(12)], name=f"N{i % 3}") for i in range(30)] + [gate(90, "AA", 46.0, 4.0, "K")]
    asked = [(i, "AA", 90, None, "k", f"n{i % 3}", round(rng.uniform(1, 500), 1), 1.0) for i in range(300)]
    g, f = spark.createDataFrame(gates, GATES), spark.createDataFrame(asked, FARES)
    want = {}
    for row in asked:
        d = row[6]
        tol = max(5.0, 0.25 * d)
        errors = sorted((abs(km(46.0, 4.0, x[4], x[5]) - d), x[0]) for x in gates if x[1].lower() == row[5])
        if errors[0][0] <= tol and errors[1][0] - errors[0][0] > tol:
            want[row[0]] = errors[0][1]
    found = resolve.match_proximity(resolve.blank_endpoints(f), g)
    assert len(want) > 3 and {r.row_id: r.matched_gare_id for r in found.collect()} == want
    found.explain()
    assert "Window" not in capsys.readouterr().out


def test_asymmetry_groups_pairs_once_and_counts_as_by_hand(spark):
    """both directions come from one grouping by the unordered pair."""
    rng = random.Random(3)
    rows = [(k, rng.choice(("AA", "BB")), rng.randrange(1, 7), rng.randrange(1, 7), rng.choice((None, 0.0, 2.0, 5.0, 11.0))) for k in range(60)] + [(99, "AA", None, 3, 1.0)]
    first = {}
    for _, op, a, b, p in sorted(r for r in rows if r[2]):
        first.setdefault((op, a, b), p)
    pairs = {(op, min(a, b), max(a, b)) for op, a, b in first}
    both = [(first.get((op, a, b)), first.get((op, b, a))) for op, a, b in pairs if (op, a, b) in first and (op, b, a) in first]
    wide = sum(None not in x and min(x) > 0 and max(x) / min(x) > 2 for x in both)
    got = audits.asymmetry_audit(spark.createDataFrame(rows, "row_id long, operator string, from_gare_id long, to_gare_id long, class1 double"))
    assert tuple(got.first()) == (len(both), len(pairs) - len(both), wide)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_corridors_of_both_ends_without_grouping_by_fare(spark):
    """blank ends, unknown gates, flat fees and gates on several roads; no group for each fare and road."""
    roads = {1: "A1|A2", 2: "A2;A3", 3: "", 4: "A1", 5: "A9"}
    ends = [(1, 2), (2, 1), (1, 4), (4, 4), (1, 1), (3, 1), (3, 3), (None, 2), (2, None), (None, None), (8, 2), (8, 8)]
    fares = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "row_id long, from_gare_id long, to_gare_id long")
    got = audits.corridor_summary(fares, spark.createDataFrame(list(roads.items()), "gare_id long, all_routes string"))
    at = lambda g: set(roads.get(g, "").replace(";", "|").split("|")) - {""}
    want = {}
    for c in {x for g in roads for x in at(g)}:
        touch = [(a, b) for a, b in ends if c in at(a) | at(b)]
        want[c] = (sum(c in at(g) for g in roads), len(touch), sum(c in at(a) & at(b) for a, b in touch), sum(a == b for a, b in touch))
    assert {r.corridor: (r.n_gates, r.referencing, r.pure, r.self_loops) for r in got.collect()} == want
    assert "row_id" not in got._jdf.queryExecution().optimizedPlan().toString().replace("LogicalRDD [row_id", "")


def test_row_rejects_read_the_checks_from_what_was_written_once(spark):
    rows = [(1, "A", 1, 2, 0.5), (2, "A", 2, 1, 0.0), (3, "A", 1, 2, 0.1), (4, "A", 3, 4, 0.9), (5, "A", 5, 5, 0.0)]
    checks = spark.createDataFrame(rows, "row_id long, operator string, from_gare_id long, to_gare_id long, error double").where("row_id > 0")
    got = audits.row_rejects(checks)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and plan.count("Join") == 1
    # the median ratio is 1.1; the last row from 1 to 2 decides its direction
    assert {r.row_id: (round(r.adjusted, 6), r.rejected) for r in got.collect()} == {
        1: (0.0, False), 2: (0.0, False), 3: (0.0, False), 4: (0.727273, True), 5: (0.090909, False),
    }


def test_names_are_folded_once_for_all_flags_and_ascii_not_at_all(spark):
    g = spark.createDataFrame([("Barrière de PÉAGE",), ("Plain A1",), (None,), ("Échangeur ﬁctif",)], "n string")
    df = g.select(cleaning.name_flags(F.col("n")).alias("f"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == g.select(
        text.lower_bare("n").alias("f")
    )._jdf.queryExecution().optimizedPlan().toString().count("translate(")
    bare = g.select(text.fold_accents("n").alias("b"))
    assert [r.b for r in bare.collect()] == ["Barriere de PEAGE", "Plain A1", None, "Echangeur fictif"]
    assert "x00-\\x7F" in bare._jdf.queryExecution().optimizedPlan().toString()


def test_sourced_prices_meet_fares_that_are_hashed_not_sorted(spark):
    fares = spark.createDataFrame(
        [(1, "A", "x", "y", 1.0, 2.0), (2, "A", "x", "y", 3.0, None)], "row_id long, operator string, from_gare string, to_gare string, class1 double, class2 double"
    ).withColumns({f"class{k}": F.lit(9.0) for k in (3, 4, 5)})
    ask = spark.createDataFrame([("A", "x", "y", 1, 3.0, 10.0), ("A", "x", "y", 2, 3.0, 10.0)], "operator string, from_gare string, to_gare string, vehicle_class int, oracle_price_eur double, tolerance_pct double")
    got = audits.oracle_join(ask, fares)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.vehicle_class, r.fare_eur, r.passed) for r in got.collect()) == [(1, 3.0, True), (2, None, None)]
