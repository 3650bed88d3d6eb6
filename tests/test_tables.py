import pytest
from pyspark.sql import functions as F

from octroi.operators import matrix
from octroi.session import scratch_path
from octroi.sources import files, sinks

APRR = "MACON NORD      VILLEFRANCHE NORD   32,1   58,2 €  89,1 €  143,0 €  190,7 €  32,8 €"
AREA = "1204 CHAMBERY NORD      1310 GRENOBLE   55   6,1 €   9,4 €   15,0 €   20,2 €   3,6 €"
COFI = "A11   1   ABLIS   A10   -   PARIS (LA FOLIE BESSIN)   3,70 €   5,70 €   9,20 €   12,10 €   2,10 €"


@pytest.mark.parametrize(
    "layout,line,key,first,last",
    [
        ("plain", APRR, ("MACON NORD", "VILLEFRANCHE NORD"), 58.2, 32.8),
        ("coded", AREA, ("CHAMBERY NORD", "GRENOBLE"), 6.1, 3.6),
        ("junction", COFI, ("ABLIS", "PARIS (LA FOLIE BESSIN)"), 3.7, 2.1),
    ],
)
def test_tariff_layouts(spark, layout, line, key, first, last):
    old = line.replace("2", "9")
    rows = [("Principales liaisons PARIS - LYON 35,00 €", 1), (line, 3), (line.replace(" €", " €  ", 1), 2), (old[:-3], 4)]
    df = spark.createDataFrame(rows, "line string, line_order int").withColumn("line", F.rtrim("line"))
    r = files.parse_tariff_text(df, layout).collect()
    assert [(v["from_gare"], v["to_gare"], v["class1"], v["class5"]) for v in r] == [(*key, first, last)]


def test_matrix_checks(spark):
    points = spark.createDataFrame([(1, 1), (2, 2)], "gare_id bigint, pid bigint")
    m = spark.createDataFrame([(1, 2, 1.0, 2.0, None, None)], "from_pid bigint, to_pid bigint, tolled_s double, tolled_m double, free_s double, free_m double")
    path = files.write_matrix(m, scratch_path(spark, "m"))
    assert files.load_matrix(spark, path, points).count() == 1
    with pytest.raises(FileNotFoundError):
        files.load_matrix(spark, scratch_path(spark, "absent"), points)
    for bad in (m.union(m), m.withColumn("to_pid", F.lit(9).cast("bigint"))):
        with pytest.raises(ValueError):
            files.load_matrix(spark, files.write_matrix(bad, scratch_path(spark, "m")), points)
    with pytest.raises(ValueError):
        matrix.checked(m, points)  # double cells
    assert matrix.null_counts(m, points).first().asDict() == {"missing_tolled_s": 1, "missing_tolled_m": 1, "missing_free_s": 2, "missing_free_m": 2}


def test_csv_blank_is_null_and_junk_fails(spark, tmp_path):
    head = ",".join(f.name for f in files.FARE_SCHEMA)
    good = tmp_path / "f.csv"
    good.write_text(head + "\n1,,7,AA,,,X,,,Y,,,,1.5,,,,\n")
    r = files.read_fares(spark, str(good)).first()
    assert r["from_gare_id"] is None and r["to_gare_id"] == 7 and r["class1"] == 1.5 and r["class2"] is None
    bad = tmp_path / "b.csv"
    bad.write_text(head + "\n1,x,7,AA,,,X,,,Y,,,,1.5,,,,\n")
    with pytest.raises(Exception):
        files.read_fares(spark, str(bad)).collect()


def test_seed_upsert_and_missing_columns(spark):
    full = sinks.default_classes(spark)
    assert sinks.seed_if_empty(full.limit(0), full).count() == 5
    own = full.where("vehicle_class = 1")
    assert sinks.seed_if_empty(own, full).count() == 1
    a = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    b = spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert {tuple(r) for r in sinks.upserted(a, b, ["k"]).collect()} == {(1, "o"), (2, "n"), (3, "n")}
    marked = sinks.with_quarantine_columns(a)
    assert marked.columns == ["k", "v", "quarantined", "quarantine_reason"] and sinks.with_quarantine_columns(marked).columns == marked.columns
    assert files.read_verdicts(spark, scratch_path(spark, "none")).count() == 0


def test_flat_fee_rounding(spark):
    c = spark.createDataFrame([("X", "OP", 900001, "G", 44.1, 3.0, 11.30)], "corridor string, operator string, gare_id bigint, canonical_name string, lat double, lon double, class1 double")
    got = {r["vehicle_class"]: (r["flat_fee_eur"], r["is_conjecture"]) for r in sinks.flat_fees(c).collect()}
    assert got == {k: (11.3 if k == 1 else round(11.30 * q, 2), k != 1) for k, q in {1: 1, 2: 1.5466, 3: 2.4801, 4: 3.3333, 5: 0.5849}.items()}


def test_matrix_that_lost_a_part_is_refused(spark, tmp_path):
    points = spark.createDataFrame([(i, i) for i in range(1, 50)], "gare_id bigint, pid bigint")
    rows = [(i, i + 1, 1.0, 2.0, None, None) for i in range(1, 49)]
    m = spark.createDataFrame(rows, "from_pid bigint, to_pid bigint, tolled_s double, tolled_m double, free_s double, free_m double")
    files.write_matrix(m, str(tmp_path / "m"))
    assert files.load_matrix(spark, str(tmp_path / "m"), points).count() == 48
    part = next((tmp_path / "m").glob("part-*.parquet"))
    m.limit(40).select("from_pid", "to_pid", *[F.col(c).cast("float") for c in matrix.CELLS]).coalesce(1).write.parquet(str(tmp_path / "less"))
    part.write_bytes(next((tmp_path / "less").glob("part-*.parquet")).read_bytes())
    (tmp_path / "m" / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="manifest"):
        files.load_matrix(spark, str(tmp_path / "m"), points)


def test_junk_in_a_column_that_nobody_reads_fails(spark, tmp_path):
    head = "gare_id,canonical_name,operators,match_tier,lat,lon,score,verdict,flags\n"
    (tmp_path / "v.csv").write_text(head + '1,"A ""B""",OP,A,45.5,junk,3,OK,\n')
    with pytest.raises(Exception, match="(?i)malformed|junk"):
        files.read_verdicts(spark, str(tmp_path / "v.csv")).collect()
    (tmp_path / "w.csv").write_text(head + '1,"A ""B""",OP,A,45.5,4.5,3,"O""K",\n')
    assert [r.verdict for r in files.read_verdicts(spark, str(tmp_path / "w.csv")).collect()] == ['O"K']


def test_new_rows_that_share_a_key_leave_one(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 3), (3, "z", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, ["k"]).collect()) == [(1, "a", 1), (2, "y", 3), (3, "z", 1)]


def test_names_fold_like_compatibility_decomposition(spark):
    from octroi.functions import text

    df = spark.createDataFrame([("Česká  Œuvre ﬁn ",), ("Łódź é",), ("ŠKODA Ⅳ",), ("½ № 한글\u3000㎞",), (None,)], "name string")
    assert [r[0] for r in df.select(text.normalise_name("name")).collect()] == ["CESKA ŒUVRE FIN", "ŁODZ E", "SKODA IV", "1⁄2 NO \u1112\u1161\u11ab\u1100\u1173\u11af KM", None]
    assert [r[0] for r in df.select(text.lower_bare("name")).collect()][0] == "ceska  œuvre fin"
    assert spark.createDataFrame([("\tA |\u00a0B\n| ",)], "s string").select(text.pipe_set("s")).first()[0] == ["A", "B"]


def test_every_character_folds_like_its_decomposition(spark):
    import unicodedata

    from octroi.functions import text

    def bare(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000))]
    chars = [c for c in chars if bare(c) != c or unicodedata.category(c)[0] == "M"]
    rows = ["a" + "b".join(chars[i : i + 50]) for i in range(0, len(chars), 50)]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").select("i", text.fold_accents("s").alias("t")).collect()
    assert len(chars) > 15_000 and {r.i: r.t for r in got} == {i: bare(s) for i, s in enumerate(rows)}


def test_route_decompose_takes_own_gates_out_of_the_listed_ones(spark, capsys):
    """Own gates at the ends, in the middle, twice in a row, and none; no list of a pair is spread out to look up its legs."""
    from octroi.operators import scoring

    pairs = [(1, 1, 3), (2, 9, 2), (3, 2, 3), (4, 9, 8), (5, 4, 9)]
    status = spark.createDataFrame([(r, "AA", f, t, 1.0, 9.0, "checked") for r, f, t in pairs], "row_id long, operator string, from_gare_id long, to_gare_id long, distance_km double, measured_km double, status string")
    routes = spark.createDataFrame([(r, 7 if r < 5 else 6) for r, *_ in pairs], "row_id long, route_id long")
    on = spark.createDataFrame([(7, g, 100.0 * g) for g in (1, 2, 3, 4)], "route_id long, gare_id long, along_m double")
    gates = spark.createDataFrame([(g, f"G{g}", "AA" if g < 4 else "AA | BB") for g in (1, 2, 3, 4, 8, 9)], "gare_id long, canonical_name string, operators string")
    sold = {(1, 2), (2, 3), (1, 3), (1, 4), (9, 1), (4, 8), (3, 2), (4, 9)}
    fares = spark.createDataFrame([(i, "AA", a, b, float(10 * a + b)) for i, (a, b) in enumerate(sorted(sold))], "row_id long, operator string, from_gare_id long, to_gare_id long, class1 double")
    got = scoring.route_decompose(status, routes, on, gates, fares)
    kept = {r: [g for g in (1, 2, 3, 4) if g not in (f, t) and r < 5] for r, f, t in pairs}
    chains = {r: [f, *kept[r], t] for r, f, t in pairs}
    want = {r: ("|".join(f"G{g}" for g in kept[r]), "|".join(f"{10 * a + b:.2f}" if (a, b) in sold else "" for a, b in zip(c, c[1:]))) for r, c in chains.items()}
    assert {r.row_id: (r.intermediate_gates, r.leg_fares) for r in got.collect()} == want
    got.explain()
    assert "posexplode" not in capsys.readouterr().out


def test_requests_are_counted_before_costs_are_joined(spark):
    """five classes would be five tasks for all requests."""
    from types import SimpleNamespace

    import octroi.catalog  # noqa: F401
    from octroi.catalog import registry

    requests = spark.range(100).select((F.col("id") % 7).cast("int").alias("vehicle_class"))
    got = registry.QUERIES["seed_if_empty"](SimpleNamespace(spark=spark, requests=requests))
    assert {(r.vehicle_class, r.n_requests) for r in got.collect()} == {(k, sum(i % 7 == k for i in range(100))) for k in range(1, 6)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan[plan.index("Join") :]


def test_a_matrix_is_written_and_checked_in_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    """parts grow with the matrix, and a repeated cell is still found."""
    monkeypatch.setattr(matrix, "TASK_ROWS", 3)
    points = spark.createDataFrame([(i, i) for i in range(1, 50)], "gare_id bigint, pid bigint")
    m = spark.createDataFrame([(i, i + 1, 1.0, 2.0, None, None) for i in range(1, 49)], "from_pid bigint, to_pid bigint, tolled_s double, tolled_m double, free_s double, free_m double")
    files.write_matrix(m, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("part-*.parquet"))) > 8  # as many parts as shuffles have here
    assert files.load_matrix(spark, str(tmp_path / "m"), points).count() == 48
    files.write_matrix(m.union(m.where("from_pid = 30")), str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="twice"):
        files.load_matrix(spark, str(tmp_path / "twice"), points)


def test_tariff_lines_are_dealt_by_their_names_in_parts_that_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setitem(files.task_parts.__globals__, "TASK_ROWS", 2)
    prices = "  1,0 €  2,0 €  3,0 €  4,0 €  {} €"
    rows = [(f"A{k % 30}    B  12,5{prices.format(k)}", k) for k in range(60)]
    got = files.parse_tariff_text(spark.createDataFrame(rows, "line string, line_order long"), "plain")
    assert "RepartitionByExpression [from_gare" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.from_gare: (r.to_gare, r.class5) for r in got.collect()} == {f"A{k}": ("B", k + 30.0) for k in range(30)}
