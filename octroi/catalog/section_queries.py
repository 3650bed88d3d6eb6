"""Toll sections along driven routes and the sub-route search built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from octroi.catalog.audit_queries import r
from octroi.catalog.cleaning_queries import joined
from octroi.catalog.place_queries import on_route
from octroi.catalog.registry import query, view
from octroi.operators import audits, places, sections, summaries

view(
    "kept_at",
    "SELECT route_id, min(along) AS along FROM {on_route} GROUP BY route_id UNION ALL SELECT k.route_id, min(h.along) AS along FROM sv_kept_at k JOIN {on_route} h ON h.route_id = k.route_id AND h.along - k.along >= 200 GROUP BY k.route_id, k.along",
)
view("kept", "SELECT route_id, along, min(gare_id) AS gare_id FROM {kept_at} JOIN {on_route} USING (route_id, along) GROUP BY ALL")
view(
    "sec_raw",
    """SELECT *, sum(st) OVER (PARTITION BY route_id ORDER BY along) AS sec FROM (
    SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY along) AS pos, CASE WHEN coalesce(along - lag(along) OVER (PARTITION BY route_id ORDER BY along) > 60000, TRUE) THEN 1 ELSE 0 END AS st FROM {kept})""",
)
view(
    "all_sec",
    """SELECT route_id, CAST(dense_rank() OVER (PARTITION BY route_id ORDER BY sec) - 1 AS BIGINT) AS section_no, CAST(row_number() OVER (PARTITION BY route_id, sec ORDER BY along) - 1 AS BIGINT) AS i, gare_id, along, n
  FROM (SELECT *, count(*) OVER (PARTITION BY route_id, sec) AS n FROM {sec_raw}) WHERE n >= 2""",
)


def kept(x):
    return x.stored("kept", lambda: sections.along_route_spacing(on_route(x)))


view("windows", "SELECT route_id, section_no, greatest(min(along) - 2000, 0) AS lo, max(along) + 2000 AS hi FROM {all_sec} GROUP BY ALL")
view(
    "driven",
    """SELECT route_id, section_no, x1 + dx * t0 AS x1, y1 + dy * t0 AS y1, x1 + dx * t1 AS x2, y1 + dy * t1 AS y2, 250 + CAST(floor(lo) AS BIGINT) % 101 AS aside FROM (
    SELECT w.*, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, (greatest(lo, start) - start) / len AS t0, (least(hi, start + len) - start) / len AS t1
    FROM {windows} w JOIN {segs} s ON s.route_id = w.route_id AND start < hi AND start + len > lo AND len > 0)""",
)
view("probed", "SELECT route_id, section_no, x1 + aside AS x1, y1, x2 + aside AS x2, y2 FROM {driven}")
view("both_lines", "SELECT 0 AS line, route_id, section_no, x1, y1, x2, y2 FROM {driven} UNION ALL SELECT 1, * FROM {probed}")
# every vertex of either line against the whole other line
view(
    "apart",
    """SELECT line, route_id, section_no, x, y, min(round(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)), 3)) AS d FROM (
    SELECT v.*, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(1.0, greatest(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) END AS t
    FROM (SELECT line, route_id, section_no, x1 AS x, y1 AS y FROM {both_lines} UNION SELECT line, route_id, section_no, x2, y2 FROM {both_lines}) v
    JOIN {both_lines} l ON l.route_id = v.route_id AND l.section_no = v.section_no AND l.line <> v.line) GROUP BY ALL""",
)
view("free_sec", "SELECT route_id, section_no FROM {apart} GROUP BY ALL HAVING max(d) <= 300")
view(
    "sec",
    "SELECT route_id, CAST(dense_rank() OVER (PARTITION BY route_id ORDER BY section_no) - 1 AS BIGINT) AS section_no, i, gare_id, along, n FROM {all_sec} WHERE (route_id, section_no) NOT IN (SELECT (route_id, section_no) FROM {free_sec})",
)


def all_secs(x):
    return x.stored("sections", lambda: sections.route_sections(kept(x)))


def untolled(x):
    segs = places.route_segments(x.vertices)
    windows = sections.section_windows(all_secs(x))
    driven = x.stored("driven_stretch", lambda: sections.driven_stretch(windows, segs))
    return x.stored("untolled", lambda: sections.untolled_sections(driven, probe_lines(driven, windows)).select("route_id", "section_no"))


def secs(x):
    """Sections that are paid for: those beside a free road are dropped before anything is priced."""
    return x.stored("paid_sections", lambda: sections.drop_untolled(all_secs(x), untolled(x)))


@query("along_route_spacing", "SELECT route_id, gare_id, round(along, 0) AS along_m FROM {kept}")
def _(x):
    return kept(x).select("route_id", "gare_id", r("along_m", 0))


@query(
    "route_legs",
    "SELECT * FROM (SELECT route_id, CAST(pos AS BIGINT) AS pos, gare_id AS from_gare_id, lead(gare_id) OVER w AS to_gare_id, round(lead(along) OVER w - along, 0) AS leg_m FROM {sec_raw} WINDOW w AS (PARTITION BY route_id ORDER BY along)) WHERE to_gare_id IS NOT NULL",
)
def _(x):
    return sections.route_legs(kept(x)).select("route_id", "pos", "from_gare_id", "to_gare_id", r("leg_m", 0))


@query("route_sections", "SELECT route_id, section_no, i, gare_id, n FROM {all_sec}")
def _(x):
    return all_secs(x).select("route_id", "section_no", "i", "gare_id", "n")


_THIN = "CASE WHEN n <= 6 THEN range(0, n) ELSE list_distinct(list_transform(range(0, 6), lambda k: CAST(round_even(k * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT))) END"
view("thin", f"SELECT DISTINCT route_id, section_no, n, {_THIN} AS t FROM {{sec}}")


@query("thin_indices", "SELECT route_id, section_no, n, array_to_string(list_sort(t), ',') AS idx FROM {thin}")
def _(x):
    s = secs(x).select(*sections.SECTION, "n").distinct()
    return s.select(*sections.SECTION, "n", joined(sections.thin_indices(F.col("n")), ",").alias("idx"))


view("gate_links", "SELECT a.gare_id AS a, b.gare_id AS b, max(q.price) AS price FROM {prices} q JOIN {aliases} a ON a.alias_id = q.from_gare_id JOIN {aliases} b ON b.alias_id = q.to_gare_id GROUP BY ALL")
view("links", "SELECT s.route_id, s.section_no, s.i, t.i AS j, l.price FROM {sec} s JOIN {sec} t ON t.route_id = s.route_id AND t.section_no = s.section_no AND s.i < t.i JOIN {gate_links} l ON l.a = s.gare_id AND l.b = t.gare_id")
view(
    "cuts",
    "SELECT s.route_id, s.section_no, s.i AS k FROM {sec} s LEFT JOIN {links} l ON l.route_id = s.route_id AND l.section_no = s.section_no AND l.i <= s.i AND l.j > s.i WHERE s.i < s.n - 1 GROUP BY ALL HAVING count(l.i) = 0",
)
view(
    "run_rows",
    "SELECT s.route_id, s.section_no, s.i, s.n, c.k IS NOT NULL AS is_cut, coalesce(sum(CASE WHEN c.k IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.route_id, s.section_no ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM {sec} s LEFT JOIN {cuts} c ON c.route_id = s.route_id AND c.section_no = s.section_no AND c.k = s.i",
)


def links(x):
    return x.stored("section_links", lambda: sections.section_links(secs(x), x.gates, audits.cheapest_fares(x.fares)))


@query("section_links", "SELECT * FROM {links}")
def _(x):
    return links(x)


@query("section_runs", "SELECT route_id, section_no, i, is_cut, CAST(run AS BIGINT) AS run FROM {run_rows}")
def _(x):
    return sections.section_runs(secs(x), links(x)).select("route_id", "section_no", "i", "is_cut", "run")


# One row a pair; a round reads the pairs that the last one made cheaper.
view(
    "hops",
    """USING KEY route_id, section_no, i, j OF route_id, section_no, i, j, price
  SELECT route_id, section_no, i, j, price FROM {links}
  UNION ALL
  SELECT c.* FROM (SELECT s.route_id, s.section_no, s.i, l.j, min(s.price + l.price) AS price FROM sv_hops s JOIN {links} l ON l.route_id = s.route_id AND l.section_no = s.section_no AND l.i = s.j GROUP BY ALL) c
  LEFT JOIN recurring.sv_hops o ON o.route_id = c.route_id AND o.section_no = c.section_no AND o.i = c.i AND o.j = c.j
  WHERE o.price IS NULL OR c.price < o.price""",
)
view("chains", "SELECT h.route_id, h.section_no, h.i, h.j, coalesce(l.price, h.price) AS price FROM {hops} h LEFT JOIN {links} l USING (route_id, section_no, i, j)")
view("run_bounds", "SELECT route_id, section_no, run, min(i) AS lo, max(i) AS hi FROM {run_rows} GROUP BY ALL")
view("pairs", "SELECT route_id, section_no, n, i, j FROM (SELECT *, unnest(t) AS j FROM (SELECT *, unnest(t) AS i FROM {thin})) WHERE i < j")
view(
    "cp",
    """SELECT p.route_id, p.section_no, p.n, p.i, p.j, sum(CASE WHEN greatest(p.i, lo) >= least(p.j, hi) THEN 0 ELSE c.price END) AS price
  FROM {pairs} p JOIN {run_bounds} b ON b.route_id = p.route_id AND b.section_no = p.section_no AND lo <= p.j AND hi >= p.i
  LEFT JOIN {chains} c ON c.route_id = p.route_id AND c.section_no = p.section_no AND c.i = greatest(p.i, lo) AND c.j = least(p.j, hi)
  WHERE (p.route_id, p.section_no, p.i) NOT IN (SELECT (route_id, section_no, k) FROM {cuts}) AND (p.route_id, p.section_no, p.j - 1) NOT IN (SELECT (route_id, section_no, k) FROM {cuts})
  GROUP BY ALL HAVING count(CASE WHEN greatest(p.i, lo) >= least(p.j, hi) THEN 0 ELSE c.price END) = count(*) AND NOT (count(*) > 1 AND sum(CASE WHEN greatest(p.i, lo) >= least(p.j, hi) THEN 0 ELSE c.price END) = 0)""",
)


def prices(x):
    return x.stored("chain_prices", lambda: sections.chain_prices(secs(x), links(x), sections.thin_pairs(secs(x))))


@query("chain_prices", "SELECT route_id, section_no, i, j, round(price, 6) AS price FROM {cp}")
def _(x):
    return prices(x).select("route_id", "section_no", "i", "j", r("price", 6))


view("sp", "SELECT s.route_id, s.section_no, s.n, price FROM (SELECT DISTINCT route_id, section_no, n FROM {sec}) s LEFT JOIN {cp} c ON c.route_id = s.route_id AND c.section_no = s.section_no AND c.i = 0 AND c.j = s.n - 1")


@query("section_price", "SELECT route_id, section_no, round(price, 6) AS price FROM {sp}")
def _(x):
    return sections.section_price(prices(x), secs(x)).select("route_id", "section_no", r("price", 6))


view(
    "cand",
    "SELECT c.route_id, c.section_no, a.gare_id AS entry_id, b.gare_id AS exit_id, c.price, c.i = 0 AND c.j = c.n - 1 AS is_whole FROM {cp} c JOIN {sec} a ON a.route_id = c.route_id AND a.section_no = c.section_no AND a.i = c.i JOIN {sec} b ON b.route_id = c.route_id AND b.section_no = c.section_no AND b.i = c.j",
)


def cands(x):
    return sections.section_candidates(secs(x), prices(x))


@query("section_candidates", "SELECT route_id, section_no, entry_id, exit_id, round(price, 6) AS price, is_whole FROM {cand}")
def _(x):
    return cands(x).select("route_id", "section_no", "entry_id", "exit_id", r("price", 6), "is_whole")


# --- sections beside a free road ----------------------------------------------------------------


def probe_lines(driven, windows):
    """Toll-free probe of each section: the driven stretch, moved aside by 250 to 350 m, as the place on the route has it."""
    aside = windows.select(*sections.SECTION, (F.floor("lo_m") % 101 + 250).alias("aside"))
    moved = driven.join(aside, sections.SECTION)
    return moved.withColumns({"x1": F.col("x1") + F.col("aside"), "x2": F.col("x2") + F.col("aside")}).drop("aside")


@query("untolled_sections", "SELECT * FROM {free_sec}")
def _(x):
    return untolled(x)


# --- search -------------------------------------------------------------------------------------

view(
    "ends",
    """SELECT v.route_id, a.pid AS origin_pid, b.pid AS destination_pid, len.m / 25.0 AS duration_s, len.m AS distance_m FROM (SELECT DISTINCT route_id, (SELECT count(*) FROM {gates}) AS n FROM {vertices}) v
  JOIN (SELECT route_id, sum(len) AS m FROM {segs} GROUP BY route_id) len ON len.route_id = v.route_id
  JOIN {points} a ON a.gare_id = (v.route_id // 3) * 7 % n + 1 JOIN {points} b ON b.gare_id = ((v.route_id // 3) * 11 + 5) % n + 1""",
)
view(
    "pc",
    "SELECT c.route_id, c.section_no, c.entry_id, c.exit_id, a.pid AS entry_pid, b.pid AS exit_pid, c.price, c.is_whole FROM {cand} c JOIN {points} a ON a.gare_id = c.entry_id JOIN {points} b ON b.gare_id = c.exit_id",
)


def ends(x):
    """Origin and destination point, time and length per driven route; three routes make one pair."""
    n = x.gates.agg(F.count(F.lit(1))).scalar()
    pair = F.floor(F.col("route_id") / 3)
    base = places.route_segments(x.vertices).groupBy("route_id").agg(F.sum("len_m").alias("distance_m"))
    keyed = base.withColumns({"_a": pair * 7 % n + 1, "_b": (pair * 11 + 5) % n + 1})
    a = x.points.select(F.col("gare_id").alias("_a"), F.col("pid").alias("origin_pid"))
    b = x.points.select(F.col("gare_id").alias("_b"), F.col("pid").alias("destination_pid"))
    return x.stored(
        "route_ends",
        lambda: keyed.join(a, "_a").join(b, "_b").select(
            "route_id", "origin_pid", "destination_pid", (F.col("distance_m") / 25.0).alias("duration_s"), "distance_m",
            pair.alias("pair_id"), (F.col("route_id") % 3).alias("alt"),
        ),
    )


def placed_cands(x):
    return x.stored("candidates", lambda: sections.candidate_points(cands(x), x.points))


@query(
    "needed_legs",
    """SELECT DISTINCT from_pid, to_pid, FALSE AS tolled FROM (SELECT origin_pid AS from_pid, entry_pid AS to_pid FROM {pc} JOIN {ends} USING (route_id)
    UNION ALL SELECT a.exit_pid, b.entry_pid FROM {pc} a JOIN {pc} b ON b.route_id = a.route_id AND a.section_no < b.section_no
    UNION ALL SELECT exit_pid, destination_pid FROM {pc} JOIN {ends} USING (route_id) UNION ALL SELECT origin_pid, destination_pid FROM {ends})
  UNION ALL SELECT DISTINCT entry_pid, exit_pid, TRUE FROM {pc}""",
)
def _(x):
    return sections.needed_legs(ends(x), placed_cands(x))


view("free_leg", "SELECT from_pid AS a, to_pid AS b, free_s AS s FROM {legs} WHERE free_s IS NOT NULL UNION ALL SELECT DISTINCT pid, pid, 0.0 FROM {points}")
view("in_leg", "SELECT from_pid AS a, to_pid AS b, tolled_s AS s FROM {legs} WHERE tolled_s IS NOT NULL UNION ALL SELECT DISTINCT pid, pid, 0.0 FROM {points}")
view("n_sec", "SELECT route_id, count(DISTINCT section_no) AS n_sections FROM {sec} GROUP BY route_id")


def _dp_views(prefix: str, cand_filter: str, vots: str, skip: bool) -> str:
    stay = "" if skip else " WHERE ns <= k"
    view(
        f"{prefix}_stages",
        f"""SELECT 0::BIGINT AS k, route_id, coalesce(n_sections, 0) AS ns, v.vot, origin_pid AS loc, struct_pack(cost := 0.0::DOUBLE, toll := 0.0::DOUBLE, sec := 0.0::DOUBLE, nc := 0) AS v
        FROM {{ends}} LEFT JOIN {{n_sec}} USING (route_id), (VALUES {vots}) v(vot)
      UNION ALL
      SELECT k + 1, route_id, ns, vot, loc, min(v) FROM (SELECT k, route_id, ns, vot, loc, v FROM sv_{prefix}_stages{stay} UNION ALL
        SELECT d.k, d.route_id, d.ns, d.vot, c.exit_pid, struct_pack(cost := (d.v.toll + c.price) + d.vot * (d.v.sec + f.s + i.s) / 3600.0, toll := d.v.toll + c.price, sec := d.v.sec + f.s + i.s, nc := d.v.nc + 1)
        FROM sv_{prefix}_stages d JOIN {{pc}} c ON c.route_id = d.route_id AND c.section_no = d.k {cand_filter} JOIN {{free_leg}} f ON f.a = d.loc AND f.b = c.entry_pid JOIN {{in_leg}} i ON i.a = c.entry_pid AND i.b = c.exit_pid)
      WHERE k < (SELECT max(n_sections) FROM {{n_sec}}) GROUP BY ALL""",
    )
    view(
        prefix,
        f"""SELECT d.route_id, d.vot, min(struct_pack(cost := d.v.toll + d.vot * (d.v.sec + f.s) / 3600.0, toll := d.v.toll, sec := d.v.sec + f.s, nc := d.v.nc)) AS v
    FROM {{{prefix}_stages}} d JOIN {{ends}} e ON e.route_id = d.route_id JOIN {{free_leg}} f ON f.a = d.loc AND f.b = e.destination_pid
    WHERE d.k = (SELECT coalesce(max(n_sections), 0) FROM {{n_sec}}) GROUP BY ALL""",
    )
    return prefix


_dp_views("dpx", "", "(5.0::DOUBLE), (10.0), (20.0), (40.0)", True)
_dp_views("dpw", "AND c.is_whole", "(20.0::DOUBLE)", False)
_DP_COLS = "route_id, vot, round(v.cost, 4) AS cost, round(v.toll, 4) AS toll_eur, round(v.sec, 4) AS seconds, CAST(v.nc AS BIGINT) AS n_choices"


def n_sections(x):
    return secs(x).select(*sections.SECTION).distinct().groupBy("route_id").agg(F.count(F.lit(1)).alias("n_sections"))


def dp(x):
    return x.stored("section_dp", lambda: sections.section_dp(ends(x), placed_cands(x), x.legs, n_sections(x)))


def recon(x):
    whole = placed_cands(x).where("is_whole")
    return x.stored(
        "section_recon", lambda: sections.section_dp(ends(x), whole, x.legs, n_sections(x), vots=(20.0,), allow_skip=False)
    )


def _shown(d):
    return d.select("route_id", "vot", r("cost", 4), r("toll_eur", 4), r("seconds", 4), F.col("n_choices").cast("bigint").alias("n_choices"))


@query("section_dp", f"SELECT {_DP_COLS} FROM {{dpx}}")
def _(x):
    return _shown(dp(x))


@query(
    "reconstruction_gap",
    "SELECT w.route_id, round(w.v.sec / 60, 1) AS recon_min, round(duration_s / 60, 1) AS actual_min FROM {dpw} w JOIN {ends} USING (route_id)",
)
def _(x):
    j = recon(x).join(ends(x), "route_id")
    return j.select("route_id", F.round(F.col("seconds") / 60, 1).alias("recon_min"), F.round(F.col("duration_s") / 60, 1).alias("actual_min"))


view(
    "facts",
    """SELECT e.route_id, e.route_id // 3 AS pair_id, e.route_id % 3 AS alt, e.duration_s, coalesce(ns, 0) AS n_sections, coalesce(nu, 0) AS n_unpriced, coalesce(toll, 0.0) AS toll_eur, coalesce(nc, 0) AS n_cuts, origin_pid, destination_pid FROM {ends} e
  LEFT JOIN (SELECT route_id, count(*) AS ns, count(*) - count(price) AS nu, sum(price) AS toll FROM {sp} GROUP BY route_id) s ON s.route_id = e.route_id LEFT JOIN (SELECT route_id, count(*) AS nc FROM {cuts} GROUP BY route_id) c ON c.route_id = e.route_id""",
)


def facts(x):
    runs = sections.section_runs(secs(x), links(x))
    return x.stored("route_facts", lambda: sections.route_facts(ends(x), secs(x), prices(x), runs))


@query("route_facts", "SELECT route_id, pair_id, alt, n_sections, n_unpriced, n_cuts, round(toll_eur, 4) AS toll_eur FROM {facts}")
def _(x):
    f = facts(x)
    big = [F.col(c).cast("bigint").alias(c) for c in ("pair_id", "alt", "n_sections", "n_unpriced", "n_cuts")]
    return f.select("route_id", *big, r("toll_eur", 4))


view(
    "tree",
    """SELECT b.pair_id, b.vot, b.n_unpriced AS fastest_unpriced, CASE WHEN free_cost < fast_cost THEN 'notoll' ELSE 'fastest' END AS baseline, least(fast_cost, coalesce(free_cost, fast_cost)) AS base_cost, fast_eur, fast_s, t.*
  FROM (SELECT pair_id, v.vot, n_unpriced, toll_eur + v.vot * duration_s / 3600.0 AS fast_cost, toll_eur AS fast_eur, duration_s AS fast_s, v.vot * l.s / 3600.0 AS free_cost FROM {facts} f LEFT JOIN {free_leg} l ON l.a = f.origin_pid AND l.b = f.destination_pid, (VALUES (5.0::DOUBLE), (10.0), (20.0), (40.0)) v(vot) WHERE alt = 0) b
  LEFT JOIN (SELECT pair_id AS p_id, vot AS p_vot, min(struct_pack(cost := cost, alt := alt, o := o, toll := toll, sec := sec, kind := kind, nc := nc)) AS t FROM (
    SELECT pair_id, v.vot, toll_eur + v.vot * duration_s / 3600.0 AS cost, alt, FALSE AS o, toll_eur AS toll, duration_s AS sec, CASE WHEN alt = 0 THEN 'asis' ELSE 'other_alt' END AS kind, 0 AS nc FROM {facts}, (VALUES (5.0::DOUBLE), (10.0), (20.0), (40.0)) v(vot) WHERE n_unpriced = 0
    UNION ALL SELECT pair_id, vot, d.v.cost, alt, TRUE, d.v.toll, d.v.sec, CASE WHEN d.v.nc > 0 THEN 'surgery' ELSE 'all_skip' END, d.v.nc FROM {dpx} d JOIN {facts} USING (route_id)) GROUP BY ALL) t ON t.p_id = b.pair_id AND t.p_vot = b.vot""",
)
view(
    "tree_rows",
    """SELECT pair_id, vot, fastest_unpriced, baseline, round(base_cost, 2) AS baseline_cost, round(t.cost, 2) AS cost, round(t.toll, 2) AS toll_eur, t.alt AS alt, t.kind AS kind, t.nc AS n_choices,
    round(base_cost - t.cost, 2) AS gain, round(fast_eur - t.toll, 2) AS eur_saved, round((t.sec - fast_s) / 60, 1) AS min_added FROM {tree}""",
)


def tree(x):
    no_toll = (
        ends(x).where("alt = 0")
        .join(x.legs.select(F.col("from_pid").alias("origin_pid"), F.col("to_pid").alias("destination_pid"), "free_s"), ["origin_pid", "destination_pid"], "left")
        .select("pair_id", F.when(F.col("origin_pid") == F.col("destination_pid"), 0.0).otherwise(F.col("free_s")).alias("free_s"))
    )
    return x.stored("tree", lambda: sections.tree_vs_baseline(facts(x), dp(x), no_toll))


@query("tree_vs_baseline", "SELECT pair_id, vot, fastest_unpriced, baseline, baseline_cost, cost, toll_eur, alt, kind, CAST(n_choices AS BIGINT) AS n_choices FROM {tree_rows}")
def _(x):
    t = tree(x)
    return t.select("pair_id", "vot", F.col("fastest_unpriced").cast("bigint").alias("fastest_unpriced"), "baseline", "baseline_cost", "cost", "toll_eur", "alt", "kind", F.col("n_choices").cast("bigint").alias("n_choices"))


@query(
    "subroute_summary",
    """SELECT vot, count(*) AS n_pairs, count(*) FILTER (gain > 0.01) AS n_wins, count(*) FILTER (gain > 0.01 AND kind = 'surgery') AS n_surgery, round(median(gain), 4) AS median_gain, round(median(eur_saved), 4) AS median_eur_saved, round(median(min_added), 4) AS median_min_added
  FROM {tree_rows} WHERE fastest_unpriced = 0 GROUP BY vot""",
)
def _(x):
    s = summaries.subroute_summary(tree(x))
    return s.select("vot", "n_pairs", "n_wins", "n_surgery", r("median_gain", 4), r("median_eur_saved", 4), r("median_min_added", 4))


@query(
    "engine_compare",
    """SELECT vot, count(*) AS n_pairs, count(*) FILTER (diff < -0.01) AS a_wins, count(*) FILTER (diff > 0.01) AS b_wins, count(*) FILTER (abs(diff) <= 0.01) AS ties, round(median(diff), 4) AS median_diff, round(median(a_eur), 4) AS median_a_eur, round(median(b_eur), 4) AS median_b_eur
  FROM (SELECT t.pair_id, t.vot, round(round(d.v.cost, 2) - t.cost, 2) AS diff, round(d.v.toll, 2) AS a_eur, t.toll_eur AS b_eur FROM {dpx} d JOIN {facts} f USING (route_id) JOIN {tree_rows} t ON t.pair_id = f.pair_id AND t.vot = d.vot WHERE f.alt = 0) GROUP BY vot""",
)
def _(x):
    """Alternative 0's combination against the best of all alternatives."""
    f = facts(x).where("alt = 0").select("route_id", "pair_id")
    a = dp(x).join(f, "route_id").select("pair_id", "vot", F.round("cost", 2).alias("cost"), F.round("toll_eur", 2).alias("toll_eur"))
    c = summaries.engine_compare(a, tree(x).where("cost IS NOT NULL"))
    return c.select("vot", "n_pairs", "a_wins", "b_wins", "ties", r("median_diff", 4), r("median_a_eur", 4), r("median_b_eur", 4))


@query(
    "pair_diagnostics",
    """SELECT f.pair_id, count(*) AS n_alternatives, count(*) FILTER (n_unpriced > 0) AS alts_unpriced, max(n_cuts) FILTER (alt = 0) AS fastest_cuts, string_agg(alt || ':' || n_sections || ':' || n_unpriced, '|' ORDER BY alt) AS alternatives,
    max(round(w.v.sec / 60, 1)) FILTER (alt = 0) AS recon_full_min FROM {facts} f LEFT JOIN {dpw} w ON w.route_id = f.route_id GROUP BY f.pair_id""",
)
def _(x):
    d = sections.pair_diagnostics(facts(x), recon(x))
    alts = F.transform("alternatives", lambda v: F.concat_ws(":", v["alt"].cast("string"), v["n_sections"].cast("string"), v["n_unpriced"].cast("string")))
    return d.select("pair_id", "n_alternatives", "alts_unpriced", F.col("fastest_cuts").cast("bigint").alias("fastest_cuts"), F.array_join(alts, "|").alias("alternatives"), "recon_full_min")
