"""Toll sections of driven routes: spacing, grouping, prices, candidates and the stage-wise search."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.operators.places import class_prices
from octroi.operators.ranking import row_positions, running_total
from octroi.operators.relax import relax
from octroi.operators.spatial import points_near_polylines
from octroi.session import cut_lineage, written

SPACING_M = 200.0
GAP_M = 60_000.0
MAX_THIN = 6
PROBE_MARGIN_M = 2_000.0
FREE_ROAD_M = 300.0
VOTS = (5.0, 10.0, 20.0, 40.0)
#: Classes of gates in a part of a block of fares, least number of parts, and most places a block is meant to hold.
PART_CLASSES, LEAST_PARTS, BLOCK_PLACES = 8192, 4, 2_000_000
#: Pairs of places and starts of chains that are looked at together.
PAIRS_AT_ONCE, STARTS_AT_ONCE = 4_000_000, 64
#: Most links of a section that are searched in one task.
SECTION_LINKS = 2_000_000

SECTION = ["route_id", "section_no"]


def next_kept(places: DataFrame, min_m: float) -> DataFrame:
    """route_id, along_m, next_m: where the rule goes on after each place that is kept, within its run of bins.

    In bins of `min_m`, the first place at least `min_m` on lies in the next bin or is the first of the one behind
    that. After an empty bin the rule begins anew, so a place before one leads nowhere.
    """
    bins = places.groupBy("route_id", "bin").agg(F.min("along_m").alias("head"))
    ahead = places.select("route_id", (F.col("bin") - 1).alias("bin"), F.col("along_m").alias("ahead_m"))
    near = places.join(ahead, ["route_id", "bin"]).groupBy("route_id", "bin", "along_m").agg(F.min(F.when(F.col("ahead_m") - F.col("along_m") >= min_m, F.col("ahead_m"))).alias("near_m"))
    behind = bins.select("route_id", (F.col("bin") - 2).alias("bin"), F.col("head").alias("far_m"))
    found = near.join(behind, ["route_id", "bin"], "left").select("route_id", "along_m", F.coalesce("near_m", "far_m").alias("next_m"))
    return found.where("next_m is not null")


def along_route_spacing(hits: DataFrame, min_m: float = SPACING_M) -> DataFrame:
    """Gates kept along each route: the next one lies at least `min_m` after the last one kept.

    Each choice depends on the one before, but only through where it leads: every place has one that follows it
    if it is kept, so what is kept is what the starts of the runs reach. Pointers are doubled until none
    is left; the rounds grow with the logarithm of the longest run. Gates at one place are reduced to the first.
    """
    first = hits.groupBy("route_id", "along_m").agg(F.min("gare_id").alias("gare_id"))
    first = written(first.withColumn("bin", F.floor(F.col("along_m") / min_m)), "places")
    bins = first.groupBy("route_id", "bin").agg(F.min("along_m").alias("along_m"))
    reached = bins.join(bins.select("route_id", (F.col("bin") + 1).alias("bin")), ["route_id", "bin"], "left_anti").select("route_id", "along_m")
    jump = written(next_kept(first, min_m), "next-kept")
    while not jump.isEmpty():
        further = reached.join(jump, ["route_id", "along_m"]).select("route_id", F.col("next_m").alias("along_m"))
        reached = written(reached.unionByName(further), "kept-places")
        beyond = jump.select("route_id", F.col("along_m").alias("next_m"), F.col("next_m").alias("beyond_m"))
        jump = written(jump.join(beyond, ["route_id", "next_m"]).select("route_id", "along_m", F.col("beyond_m").alias("next_m")), "next-kept")
    return first.join(reached, ["route_id", "along_m"]).select("route_id", "gare_id", "along_m")


def numbered_gates(kept: DataFrame) -> DataFrame:
    """Kept gates with their 1-based position on the route."""
    return row_positions(kept, ["route_id"], ["along_m"], F.floor(F.col("along_m") / 100_000.0), "pos")


def route_legs(kept: DataFrame) -> DataFrame:
    """Consecutive kept gates of each route."""
    n = numbered_gates(kept)
    nxt = n.select("route_id", (F.col("pos") - 1).alias("pos"), F.col("gare_id").alias("to_gare_id"), F.col("along_m").alias("to_m"))
    return n.join(nxt, ["route_id", "pos"]).select(
        "route_id", "pos", F.col("gare_id").alias("from_gare_id"), "to_gare_id", (F.col("to_m") - F.col("along_m")).alias("leg_m")
    )


def route_sections(kept: DataFrame, gap_m: float = GAP_M) -> DataFrame:
    """(route, section_no, i, gare_id, along_m, n): a wide gap starts a section; single gates make none.

    Sections are numbered from 0 per route after the single gates are gone.
    """
    n = numbered_gates(kept)
    prev = n.select("route_id", (F.col("pos") + 1).alias("pos"), F.col("along_m").alias("_p"))
    flagged = n.join(prev, ["route_id", "pos"], "left").withColumn(
        "_start", F.when(F.col("_p").isNull() | (F.col("along_m") - F.col("_p") > gap_m), 1.0).otherwise(0.0)
    )
    block = F.floor(F.col("pos") / 1024)
    marked = running_total(flagged, ["route_id"], "pos", block, "_start", "_before").withColumn(
        "_sec", (F.col("_before") + F.col("_start")).cast("bigint")
    )
    sizes = marked.groupBy("route_id", "_sec").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("_first")).where("n >= 2")
    order = row_positions(sizes, ["route_id"], ["_sec"], F.floor(F.col("_sec") / 1024), "_no")
    return marked.join(order, ["route_id", "_sec"]).select(
        "route_id", (F.col("_no") - 1).alias("section_no"), (F.col("pos") - F.col("_first")).alias("i"), "gare_id", "along_m", "n"
    )


def thin_indices(n):
    """At most six evenly spaced indices with both ends; halves round to even."""
    spread = F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.lit(MAX_THIN - 1)), lambda i: F.bround(i * (n - 1) / F.lit(MAX_THIN - 1.0)).cast("bigint"))
    )
    return F.when(n <= MAX_THIN, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(spread)


def thin_pairs(sections: DataFrame) -> DataFrame:
    """(route, section, i, j), i < j, over the thinned indices: at most 15 per section."""
    per = sections.select(*SECTION, "n").distinct().withColumn("t", thin_indices(F.col("n").cast("bigint")))
    return per.select(*SECTION, "n", "t", F.explode("t").alias("i")).select(
        *SECTION, "n", "i", F.explode(F.filter("t", lambda v: v > F.col("i"))).alias("j")
    )


def met_pairs(places: pa.Table, fares: pa.Table) -> pa.Table:
    """Links of one block: places (section, i, cls, leaves) meet the block's fares (a_cls, b_cls, price).

    A table of truth values over the classes of the block tells which pairs of places have a fare; only for these is it looked up.
    """
    col = lambda t, c: t[c].to_numpy()
    a_ids, a = np.unique(col(fares, "a_cls"), return_inverse=True)
    b_ids, b = np.unique(col(fares, "b_cls"), return_inverse=True)
    key = a * len(b_ids) + b
    order = np.argsort(key)
    key, price = key[order], col(fares, "price")[order]
    sold = np.zeros(len(a_ids) * len(b_ids), bool)
    sold[key] = True

    def side(leaves: bool, ids: np.ndarray):
        t = places.filter(pc.equal(places["leaves"], leaves))
        at = np.minimum(np.searchsorted(ids, col(t, "cls")), len(ids) - 1)
        known = ids[at] == col(t, "cls")
        return [col(t, c)[known] for c in (*SECTION, "i")] + [at[known]]

    (r1, s1, i1, c1), (r2, s2, i2, c2) = side(True, a_ids), side(False, b_ids)
    names, section = np.unique(np.stack([np.append(r1, r2), np.append(s1, s2)], 1), axis=0, return_inverse=True)
    section, wide = section.reshape(-1), 1 + max([int(x.max()) for x in (i1, i2) if len(x)], default=0)
    from_key, to_key = section[: len(r1)] * wide + i1, section[len(r1) :] * wide + i2
    order = np.argsort(to_key)
    to_key, c2 = to_key[order], c2[order]
    first = np.searchsorted(to_key, from_key, "right")
    count = np.searchsorted(to_key, (from_key // wide + 1) * wide) - first
    ends, parts, begin = np.cumsum(count), [], 0
    while begin < len(count):  # some millions of pairs at a time
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        n = count[begin:stop]
        src = np.repeat(np.arange(begin, stop), n)
        dst = np.arange(len(src)) + np.repeat(first[begin:stop] - (ends[begin:stop] - n - done), n)
        pair = c1[src] * len(b_ids) + c2[dst]
        hit = sold[pair]
        parts.append((from_key[src[hit]], to_key[dst[hit]], price[np.searchsorted(key, pair[hit])]))
        begin = stop
    start, end, paid = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in enumerate((np.int64, np.int64, np.float64)))
    names = names[start // wide] if len(start) else np.empty((0, 2), np.int64)
    columns = dict(zip((*SECTION, "i", "j", "price"), (names[:, 0], names[:, 1], start % wide, end % wide, paid), strict=True))
    return pa.table({k: pa.array(v, pa.float64() if k == "price" else pa.int64()) for k, v in columns.items()})


def section_links(sections: DataFrame, gates: DataFrame, prices: DataFrame) -> DataFrame:
    """(route, section, i, j, price): the highest alias price between two gates of a section.

    The priced pairs of alias classes are dealt into blocks by both classes, and a place goes to the blocks of its class:
    what is exchanged are places and fares, a few times each, and never a place with all fares of its gate. Where many places
    meet in a block, the sections are dealt into slices.
    """
    member, spread = class_prices(gates, prices)
    spread = written(spread, "class-prices")
    at = written(sections.select(*SECTION, "i", "gare_id").join(member, "gare_id").select(*SECTION, "i", "cls"), "class-places")
    parts = max(LEAST_PARTS, ceil(member.agg(F.count_distinct("cls")).first()[0] / PART_CLASSES))
    slices = max(1, ceil(2 * at.count() / parts / BLOCK_PLACES))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = ["p", "q", "slice"]
    own = at.withColumns({"own": part("cls"), "slice": F.pmod(F.xxhash64(*SECTION), F.lit(slices)).cast("int")}).withColumn("other", every(parts))
    sides = [own.select(*SECTION, "i", "cls", F.lit(x).alias("leaves"), F.col("own" if x else "other").alias("p"), F.col("other" if x else "own").alias("q"), "slice") for x in (True, False)]
    places = sides[0].unionByName(sides[1])
    fares = spread.withColumns({"p": part("a_cls"), "q": part("b_cls")}).withColumn("slice", every(slices))
    schema = "route_id bigint, section_no bigint, i bigint, j bigint, price double"
    shape = pa.schema([(c, pa.float64() if c == "price" else pa.int64()) for c in (*SECTION, "i", "j", "price")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return met_pairs(left, right) if left.num_rows and right.num_rows else shape.empty_table()

    return places.groupBy(*block).cogroup(fares.groupBy(*block)).applyInArrow(meet, schema)


def section_runs(sections: DataFrame, links: DataFrame) -> DataFrame:
    """Positions with `is_cut` (no link spans the boundary behind it) and the run they belong to.

    Coverage is a running count of link starts minus ends, so no link is spread over its boundaries.
    """
    deltas = (
        links.select(*SECTION, F.explode(F.array(F.struct(F.col("i").alias("i"), F.lit(1.0).alias("d")), F.struct(F.col("j").alias("i"), F.lit(-1.0).alias("d")))).alias("v"))
        .select(*SECTION, "v.i", "v.d")
        .groupBy(*SECTION, "i")
        .agg(F.sum("d").alias("d"))
    )
    p = sections.join(deltas, [*SECTION, "i"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    block = F.floor(F.col("i") / 1024)
    p = running_total(p, SECTION, "i", block, "d", "_b").withColumn(
        "is_cut", (F.col("i") < F.col("n") - 1) & (F.col("_b") + F.col("d") <= 0)
    )
    p = p.withColumn("_c", F.col("is_cut").cast("double"))
    return running_total(p, SECTION, "i", block, "_c", "_r").select(*SECTION, "i", "gare_id", "n", "is_cut", F.col("_r").cast("bigint").alias("run"))


def chains_of(wanted: pa.Table, links: pa.Table) -> pa.Table:
    """Cheapest chain of one section's links for each wanted (a, b), as `chained`. Links lead ahead, so one pass in order of their starts is enough."""
    col = lambda t, c: t[c].to_numpy()
    i = col(links, "i")
    order = np.argsort(i, kind="stable")
    i, j, price = i[order], col(links, "j")[order], col(links, "price")[order]
    leaves, first = np.unique(i, return_index=True)
    ends = np.append(first[1:], len(i))
    a, b = col(wanted, "a"), col(wanted, "b")
    starts, chained = np.unique(a), np.full(len(a), np.inf)
    for group in np.array_split(starts, ceil(len(starts) / STARTS_AT_ONCE)):
        mine = np.flatnonzero((a >= group[0]) & (a <= group[-1]))
        low, top = int(group[0]), int(b[mine].max())
        cost = np.full((top - low + 1, len(group)), np.inf)
        cost[group - low, np.arange(len(group))] = 0.0
        for k in range(np.searchsorted(leaves, low), np.searchsorted(leaves, top)):
            here = cost[leaves[k] - low]
            if np.isfinite(here).any():
                to, w = j[first[k] : ends[k]], price[first[k] : ends[k]]
                near = to <= top
                cost[to[near] - low] = np.minimum(cost[to[near] - low], here + w[near, None])
        chained[mine] = cost[b[mine] - low, np.searchsorted(group, a[mine])]
    return wanted.select([*SECTION, "a", "b"]).append_column("chained", pa.array(chained)).filter(pa.array(np.isfinite(chained)))


def cheapest_chains(missing: DataFrame, links: DataFrame, most: int = SECTION_LINKS) -> DataFrame:
    """(route, section, a, b, chained): price of the cheapest chain of links from a to b, where there is one.

    A section's links meet in one task; sections of more than `most` links are searched round by round.
    """
    large = written(links.groupBy(*SECTION).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*SECTION), "large-sections")
    wanted = missing.select(*SECTION, "a", "b")
    schema = "route_id bigint, section_no bigint, a bigint, b bigint, chained double"
    shape = pa.schema([(c, pa.float64() if c == "chained" else pa.int64()) for c in (*SECTION, "a", "b", "chained")])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return chains_of(left, right).cast(shape) if left.num_rows and right.num_rows else shape.empty_table()

    asked = links.join(wanted.select(*SECTION).distinct(), SECTION, "left_semi")
    if large.isEmpty():
        return wanted.groupBy(*SECTION).cogroup(asked.groupBy(*SECTION)).applyInArrow(search, schema)
    found = wanted.join(large, SECTION, "left_anti").groupBy(*SECTION).cogroup(asked.join(large, SECTION, "left_anti").groupBy(*SECTION)).applyInArrow(search, schema)
    rest, hard = wanted.join(large, SECTION), links.join(large, SECTION)
    far = written(rest.groupBy(*SECTION, F.col("a").alias("src")).agg(F.max("b").alias("cap_b")), "chain-starts")
    seeds = far.select(*SECTION, "src", F.col("src").alias("node"), F.lit(0.0).alias("c0"))
    moves = hard.select(*SECTION, F.col("i").alias("node"), F.col("j").alias("to_node"), F.lit(0).alias("kind"), F.col("price").alias("w"))
    within = F.when(F.col("to_node") <= F.col("cap_b"), F.col("w"))
    by_rounds = relax(seeds, moves, [*SECTION, "src"], lambda _: within, context=far, on=[*SECTION, "node"])
    reached = by_rounds.select(*SECTION, F.col("src").alias("a"), F.col("node").alias("b"), F.col("c0").alias("chained"))
    return found.unionByName(rest.join(reached, [*SECTION, "a", "b"]))


def chain_prices(sections: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Price of each wanted (route, section, i, j); unpriceable pairs have no row.

    Inside a run the cheapest chain of links counts unless a direct link exists; over cuts the
    runs add up; a span that begins or ends at a cut, or sums to nothing over several runs, is
    unpriceable.
    """
    runs = written(section_runs(sections, links), "section-runs")
    bounds = runs.groupBy(*SECTION, "run").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    cuts = runs.where("is_cut").select(*SECTION, F.col("i").alias("k"))
    open_pairs = pairs.join(cuts.withColumnRenamed("k", "i"), [*SECTION, "i"], "left_anti").withColumn("_k", F.col("j") - 1).join(
        cuts.withColumnRenamed("k", "_k"), [*SECTION, "_k"], "left_anti"
    ).select(*SECTION, "i", "j")
    spans = written(
        open_pairs.join(bounds, SECTION)
        .where("lo <= j AND hi >= i")
        .select(*SECTION, "i", "j", F.greatest("i", "lo").alias("a"), F.least("j", "hi").alias("b")),
        "section-spans",
    )
    # Chains are searched only from span starts without a direct link.
    direct = links.select(*SECTION, F.col("i").alias("a"), F.col("j").alias("b"), F.col("price").alias("direct"))
    need = spans.where("a < b").select(*SECTION, "a", "b").distinct()
    missing = need.join(direct, [*SECTION, "a", "b"], "left_anti")
    chain = cheapest_chains(missing, links)
    part = (
        spans.join(direct, [*SECTION, "a", "b"], "left")
        .join(chain, [*SECTION, "a", "b"], "left")
        .withColumn("v", F.when(F.col("a") >= F.col("b"), 0.0).otherwise(F.coalesce("direct", "chained")))
    )
    total = part.groupBy(*SECTION, "i", "j").agg(
        F.sum("v").alias("price"), F.count("v").alias("known"), F.count(F.lit(1)).alias("touched")
    )
    return total.where("known = touched AND NOT (touched > 1 AND price = 0)").select(*SECTION, "i", "j", "price")


def section_price(prices: DataFrame, sections: DataFrame) -> DataFrame:
    """End-to-end price per section, NULL where it cannot be priced."""
    whole = sections.select(*SECTION, "n").distinct().select(*SECTION, "n", F.lit(0).cast("bigint").alias("i"), (F.col("n") - 1).alias("j"))
    return whole.join(prices, [*SECTION, "i", "j"], "left").select(*SECTION, "n", "price")


def section_candidates(sections: DataFrame, prices: DataFrame) -> DataFrame:
    """(route, section, entry, exit, price) over the thinned gates of each section."""
    at = sections.select(*SECTION, "i", "gare_id", "n")
    return (
        prices.join(at.withColumnRenamed("gare_id", "entry_id"), [*SECTION, "i"])
        .join(at.select(*SECTION, F.col("i").alias("j"), F.col("gare_id").alias("exit_id")), [*SECTION, "j"])
        .select(*SECTION, "entry_id", "exit_id", "price", ((F.col("i") == 0) & (F.col("j") == F.col("n") - 1)).alias("is_whole"))
    )


# --- sections beside a free road ----------------------------------------------------------------


def section_windows(sections: DataFrame) -> DataFrame:
    """Stretch of the driven line to probe: the section and a margin on both sides."""
    return sections.groupBy(*SECTION).agg(
        F.greatest(F.min("along_m") - PROBE_MARGIN_M, F.lit(0.0)).alias("lo_m"), (F.max("along_m") + PROBE_MARGIN_M).alias("hi_m")
    )


def driven_stretch(windows: DataFrame, segments: DataFrame, cell_m: float = 50_000.0) -> DataFrame:
    """Clipped driven segments per section; sections meet segments in cells of driven distance."""
    def cells(lo, hi):
        return F.explode(F.sequence(F.floor(lo / cell_m).cast("bigint"), F.floor(hi / cell_m).cast("bigint")))

    end = F.col("start_m") + F.col("len_m")
    seg = segments.where("len_m > 0").withColumn("end_m", end).withColumn("_c", cells(F.col("start_m"), F.col("end_m")))
    win = windows.withColumn("_c", cells(F.col("lo_m"), F.col("hi_m")))
    met = (
        win.join(seg, ["route_id", "_c"])
        .where("start_m < hi_m AND end_m > lo_m")
        .dropDuplicates([*SECTION, "seq"])
        .withColumn("_t0", (F.greatest("lo_m", "start_m") - F.col("start_m")) / F.col("len_m"))
        .withColumn("_t1", (F.least("hi_m", "end_m") - F.col("start_m")) / F.col("len_m"))
    )
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cut = met.select(
        *SECTION, "seq",
        (F.col("x1") + dx * F.col("_t0")).alias("ax"), (F.col("y1") + dy * F.col("_t0")).alias("ay"),
        (F.col("x1") + dx * F.col("_t1")).alias("bx"), (F.col("y1") + dy * F.col("_t1")).alias("by"),
    )
    return cut.select(*SECTION, "seq", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2")).withColumn(
        "len_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ).withColumn("start_m", F.lit(0.0))


def _ends(segments: DataFrame) -> DataFrame:
    a = segments.select(*SECTION, F.col("x1").alias("x"), F.col("y1").alias("y"))
    return a.union(segments.select(*SECTION, "x2", "y2")).distinct()


def untolled_sections(driven: DataFrame, probe: DataFrame, max_m: float = FREE_ROAD_M) -> DataFrame:
    """Sections whose toll-free probe line runs along the driven line within `max_m` both ways.

    The Hausdorff test only asks whether some vertex of either line is farther than `max_m` from
    the other line: a range join finds the near vertices, an anti join the far ones.
    """
    def far(points, lines):
        near = points_near_polylines(lines, points, max_m, SECTION, own=SECTION).select(*SECTION, "x", "y")
        return points.join(near, [*SECTION, "x", "y"], "left_anti").select(*SECTION)

    probed = probe.select(*SECTION).distinct()
    driven = driven.join(probed, SECTION, "left_semi")
    apart = far(_ends(driven), probe).union(far(_ends(probe), driven)).distinct()
    return probed.join(apart, SECTION, "left_anti")


def drop_untolled(sections: DataFrame, untolled: DataFrame) -> DataFrame:
    """Sections that are paid for, numbered anew from 0 along each route. Numbers are given per section, not per gate."""
    paid = sections.join(untolled, SECTION, "left_anti")
    numbers = row_positions(paid.select(*SECTION).distinct(), ["route_id"], ["section_no"], F.floor(F.col("section_no") / 1024), "_no")
    return paid.join(numbers, SECTION).withColumn("section_no", F.col("_no") - 1).drop("_no")


# --- stage-wise search ---------------------------------------------------------------------------


def candidate_points(cands: DataFrame, points: DataFrame) -> DataFrame:
    """Candidates with entry and exit as gate points."""
    a = points.select(F.col("gare_id").alias("entry_id"), F.col("pid").alias("entry_pid"))
    b = points.select(F.col("gare_id").alias("exit_id"), F.col("pid").alias("exit_pid"))
    return cands.join(a, "entry_id").join(b, "exit_id")


def needed_legs(routes: DataFrame, cands: DataFrame) -> DataFrame:
    """Distinct legs the search can ask for: (from_pid, to_pid, tolled). `routes`: route_id, origin_pid, destination_pid."""
    c = cands.join(routes, "route_id")
    # A connector leaves the origin or any exit of an earlier section.
    first = c.select(F.col("origin_pid").alias("from_pid"), F.col("entry_pid").alias("to_pid"))
    exits = cands.select("route_id", "section_no", F.col("exit_pid").alias("from_pid")).distinct()
    entries = cands.select("route_id", F.col("section_no").alias("later_no"), F.col("entry_pid").alias("to_pid")).distinct()
    hops = exits.join(entries, "route_id").where("section_no < later_no").select("from_pid", "to_pid")
    tails = c.select(F.col("exit_pid").alias("from_pid"), F.col("destination_pid").alias("to_pid"))
    whole = routes.select(F.col("origin_pid").alias("from_pid"), F.col("destination_pid").alias("to_pid"))
    free = first.union(hops).union(tails).union(whole).distinct().withColumn("tolled", F.lit(False))
    inner = cands.select(F.col("entry_pid").alias("from_pid"), F.col("exit_pid").alias("to_pid")).distinct().withColumn("tolled", F.lit(True))
    return free.unionByName(inner)


def section_dp(routes: DataFrame, cands: DataFrame, matrix: DataFrame, n_sections: DataFrame, vots=VOTS, allow_skip: bool = True) -> DataFrame:
    """Best keep / skip / partial use of the sections per (route, VoT): cost, toll, seconds and choices.

    One join and one least-row aggregation per stage over all routes and VoTs together. A state is
    a position: the origin or an exit point, so a stage multiplies a route's few states by its at most
    15 candidates. Routes leave the rounds after their last section. Without skipping, a route with a section that
    has no candidate has no row.
    """
    free = matrix.where("free_s IS NOT NULL").select(F.col("from_pid").alias("a"), F.col("to_pid").alias("b"), F.col("free_s").alias("leg_s"))
    inner = matrix.where("tolled_s IS NOT NULL").select(F.col("from_pid").alias("entry_pid"), F.col("to_pid").alias("exit_pid"), F.col("tolled_s").alias("in_s"))
    same = F.col("entry_pid") == F.col("exit_pid")
    priced = written(
        cands.join(inner, ["entry_pid", "exit_pid"], "left")
        .withColumn("in_s", F.when(same, 0.0).otherwise(F.col("in_s")))
        .where("in_s IS NOT NULL")
        .select("route_id", "section_no", "entry_pid", "exit_pid", "entry_id", "exit_id", F.col("price").alias("toll"), "in_s"),
        "stage-candidates",
    )
    none = F.array().cast("array<struct<section_no:bigint,entry_id:bigint,exit_id:bigint,toll:double>>")
    state = routes.join(n_sections, "route_id", "left").select(
        "route_id", "destination_pid", F.coalesce("n_sections", F.lit(0)).alias("n_sections"),
        F.explode(F.array(*[F.lit(v) for v in vots])).alias("vot"), F.col("origin_pid").alias("at"),
        F.lit(0.0).alias("cost"), F.lit(0.0).alias("toll_eur"), F.lit(0.0).alias("seconds"), none.alias("choices"),
    )
    last = priced.agg(F.max("section_no")).first()[0]
    keys = ["route_id", "destination_pid", "n_sections", "vot"]
    stages = 0 if last is None else last + 1
    ended = []
    for k in range(stages):
        ended.append(state.where(F.col("n_sections") <= k))
        state = state.where(F.col("n_sections") > k)
        stage = priced.where(F.col("section_no") == k).drop("section_no")
        hop = free.withColumnsRenamed({"a": "at", "b": "entry_pid"})
        moved = (
            state.join(stage, "route_id")
            .join(hop, ["at", "entry_pid"], "left")
            .withColumn("leg_s", F.when(F.col("at") == F.col("entry_pid"), 0.0).otherwise(F.col("leg_s")))
            .where("leg_s IS NOT NULL")
            .withColumn("seconds", F.col("seconds") + F.col("leg_s") + F.col("in_s"))
            .withColumn("toll_eur", F.col("toll_eur") + F.col("toll"))
            .select(
                *keys, F.col("exit_pid").alias("at"),
                (F.col("toll_eur") + F.col("vot") * F.col("seconds") / 3600.0).alias("cost"), "toll_eur", "seconds",
                F.concat("choices", F.array(F.struct(F.lit(k).cast("bigint").alias("section_no"), "entry_id", "exit_id", "toll"))).alias("choices"),
            )
        )
        both = state.select(*moved.columns).unionByName(moved) if allow_skip else moved
        least = both.groupBy(*keys, "at").agg(F.min(F.struct("cost", "toll_eur", "seconds", F.size("choices").alias("nc"), "choices")).alias("m"))
        state = cut_lineage(least.select(*keys, "at", "m.cost", "m.toll_eur", "m.seconds", "m.choices"))
    state = state if allow_skip else state.where(F.col("n_sections") <= stages)
    for rows in ended:
        state = state.unionByName(rows)
    tail = free.withColumnsRenamed({"a": "at", "b": "destination_pid"})
    done = (
        state.join(tail, ["at", "destination_pid"], "left")
        .withColumn("leg_s", F.when(F.col("at") == F.col("destination_pid"), 0.0).otherwise(F.col("leg_s")))
        .where("leg_s IS NOT NULL")
        .withColumn("seconds", F.col("seconds") + F.col("leg_s"))
        .withColumn("cost", F.col("toll_eur") + F.col("vot") * F.col("seconds") / 3600.0)
    )
    best = done.groupBy("route_id", "vot").agg(F.min(F.struct("cost", "toll_eur", "seconds", F.size("choices").alias("nc"), "choices")).alias("m"))
    return best.select("route_id", "vot", "m.cost", "m.toll_eur", "m.seconds", F.col("m.nc").alias("n_choices"), "m.choices")


# --- comparison with the baseline ----------------------------------------------------------------


def route_facts(routes: DataFrame, sections: DataFrame, prices: DataFrame, runs: DataFrame) -> DataFrame:
    """Per alternative: sections, unpriced sections, toll and cuts, beside its driven time and length."""
    per = section_price(prices, sections).groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("price").isNull()).alias("n_unpriced"), F.sum("price").alias("toll_eur")
    )
    cuts = runs.groupBy("route_id").agg(F.count_if("is_cut").alias("n_cuts"))
    return routes.join(per, "route_id", "left").join(cuts, "route_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n_sections", "n_unpriced", "n_cuts")} | {"toll_eur": F.coalesce("toll_eur", F.lit(0.0))}
    )


def tree_vs_baseline(facts: DataFrame, dp: DataFrame, no_toll: DataFrame, vots=VOTS) -> DataFrame:
    """Per (pair, VoT): the better of fastest and toll-free, and the best alternative or combination against it.

    facts: pair_id, alt, route_id, duration_s, toll_eur, n_unpriced; dp: route_id, vot, ...; no_toll: pair_id, free_s.
    """
    grid = facts.withColumn("vot", F.explode(F.array(*[F.lit(v) for v in vots])))
    driven = F.col("toll_eur") + F.col("vot") * F.col("duration_s") / 3600.0
    asis = grid.where("n_unpriced = 0").select(
        "pair_id", "vot", driven.alias("cost"), "toll_eur", F.col("duration_s").alias("seconds"), "alt",
        F.when(F.col("alt") == 0, "asis").otherwise("other_alt").alias("kind"), F.lit(0).alias("n_choices"),
    )
    built = dp.join(facts.select("route_id", "pair_id", "alt"), "route_id").select(
        "pair_id", "vot", "cost", "toll_eur", "seconds", "alt",
        F.when(F.col("n_choices") > 0, "surgery").otherwise("all_skip").alias("kind"), "n_choices",
    )
    # Ties keep the earlier alternative, and within one the driven route before the rebuilt one.
    best = asis.unionByName(built).groupBy("pair_id", "vot").agg(
        F.min(F.struct("cost", "alt", F.col("kind").isin("surgery", "all_skip").alias("o"), "toll_eur", "seconds", "kind", "n_choices")).alias("t")
    )
    base = grid.where("alt = 0").join(no_toll, "pair_id", "left").select(
        "pair_id", "vot", driven.alias("fast_cost"), F.col("duration_s").alias("fast_s"), F.col("toll_eur").alias("fast_eur"),
        F.col("n_unpriced").alias("fastest_unpriced"), (F.col("vot") * F.col("free_s") / 3600.0).alias("free_cost"),
    )
    free_wins = F.coalesce(F.col("free_cost") < F.col("fast_cost"), F.lit(False))
    base_cost = F.least("fast_cost", "free_cost")
    return base.join(best, ["pair_id", "vot"], "left").select(
        "pair_id", "vot", "fastest_unpriced",
        F.when(free_wins, "notoll").otherwise("fastest").alias("baseline"),
        F.round(base_cost, 2).alias("baseline_cost"),
        F.round("t.cost", 2).alias("cost"), F.round("t.toll_eur", 2).alias("toll_eur"),
        F.col("t.alt").alias("alt"), F.col("t.kind").alias("kind"), F.col("t.n_choices").alias("n_choices"),
        F.round(base_cost - F.col("t.cost"), 2).alias("gain"),
        F.round(F.col("fast_eur") - F.col("t.toll_eur"), 2).alias("eur_saved"),
        F.round((F.col("t.seconds") - F.col("fast_s")) / 60.0, 1).alias("min_added"),
    )


def pair_diagnostics(facts: DataFrame, recon: DataFrame) -> DataFrame:
    """One nested row per pair: counts, rebuilt minutes and one array entry per alternative."""
    alt = F.struct("alt", "n_sections", F.round("toll_eur", 2).alias("toll_eur"), "n_unpriced")
    per = facts.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_alternatives"),
        F.count_if(F.col("n_unpriced") > 0).alias("alts_unpriced"),
        F.max(F.when(F.col("alt") == 0, F.col("n_cuts"))).alias("fastest_cuts"),
        F.max(F.when(F.col("alt") == 0, F.round(F.col("duration_s") / 60.0, 1))).alias("actual_fastest_min"),
        F.array_sort(F.collect_list(alt)).alias("alternatives"),
    )
    rebuilt = recon.join(facts.where("alt = 0").select("route_id", "pair_id"), "route_id").select(
        "pair_id", F.round(F.col("seconds") / 60.0, 1).alias("recon_full_min")
    )
    return per.join(rebuilt, "pair_id", "left")
