"""Many routing requests at once: dedupe, one search job over all weights, routes per destination."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octroi.functions.pricing import VOT_STEPS, vot_bucket, vot_grid
from octroi.operators.network import DWELL_M, DWELL_S
from octroi.functions.paths import ENTRY
from octroi.operators.blocks import Blocks, numbers_apart
from octroi.operators.relax import relax, walk, ways_back
from octroi.operators.ways import FOUND, FOUND_SQL, cheapest_ways
from octroi.session import written

SEARCH = ["origin_id", "vehicle_class", "mode"]
GROUP = ["origin_id", "destination_id", "vehicle_class", "vot_bucket"]
FASTEST = 0
BEST_BASE = 1000  # mode of the search at a request's own value of time: BEST_BASE + bucket


def bucketed(requests: DataFrame, classes: DataFrame) -> DataFrame:
    """Requests with their value-of-time bucket; the class default stands in for a blank."""
    return requests.join(classes, "vehicle_class").withColumn("vot_bucket", vot_bucket(F.coalesce("vot", "per_hour")))


def response_groups(requests: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per distinct (origin, destination, class, bucket): what has to be computed once."""
    return bucketed(requests, classes).select(*GROUP).distinct()


def searches(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Every (origin, class, weighting) to search: fastest, the value-of-time sweep, each asked bucket.

    A search covers all destinations of its origin, so destinations do not multiply the work.
    """
    starts = groups.select("origin_id", "vehicle_class").distinct().join(classes, "vehicle_class")
    sweep = starts.select("origin_id", "vehicle_class", "per_km", F.posexplode(vot_grid()).alias("i", "vot"))
    asked = groups.select("origin_id", "vehicle_class", "vot_bucket").distinct().join(classes, "vehicle_class")

    def priced(df, mode):
        return df.select(
            "origin_id", "vehicle_class", mode.cast("bigint").alias("mode"), "vot",
            F.lit(1.0).alias("k_toll"), (F.col("per_km") / 1000.0).alias("k_m"), (F.col("vot") / 3600.0).alias("k_s"),
        )

    fastest = starts.select(
        "origin_id", "vehicle_class", F.lit(FASTEST).cast("bigint").alias("mode"), F.lit(None).cast("double").alias("vot"),
        F.lit(0.0).alias("k_toll"), F.lit(0.0).alias("k_m"), F.lit(1.0).alias("k_s"),
    )
    best = asked.withColumn("vot", F.col("vot_bucket").cast("double"))
    return fastest.unionByName(priced(sweep, F.col("i") + 1)).unionByName(priced(best, F.col("vot_bucket") + BEST_BASE))


def targets(groups: DataFrame, search: DataFrame) -> DataFrame:
    """(search, destination) pairs some group needs."""
    need = groups.where("origin_id <> destination_id")
    shared = search.where(f"mode <= {VOT_STEPS}").select(*SEARCH).join(
        need.select("origin_id", "vehicle_class", "destination_id").distinct(), ["origin_id", "vehicle_class"]
    )
    own = need.select(
        "origin_id", "vehicle_class", (F.col("vot_bucket") + BEST_BASE).alias("mode"), "destination_id"
    ).distinct()
    return shared.select(*SEARCH, "destination_id").unionByName(own.select(*SEARCH, "destination_id"))


def weighted(toll, metres, seconds):
    return F.col("k_toll") * toll + F.col("k_m") * metres + F.col("k_s") * seconds


#: Most weightings of an origin and class that are searched together, as lanes of one row.
LANES = 8
#: More moves than this are dealt into blocks where no bound tells the near ones from the others.
BLOCKS_FROM = 5_000_000
#: More near moves of a class than this are searched round by round, fewer in tasks that each hold them.
NEAR_MOST = 20_000_000
#: Share of what is left for a move that makes it a very near one.
NEARER = 0.3
#: Weightings that are alike share a test of length and time.
FAR_GROUPS = 5
#: Toll moves up to this share of the way from the least to the mean one give the first bounds.
FIRST_SHARE = 1 / 16
BUNDLE = ["origin_id", "vehicle_class", "bundle"]
FACTORS = ["k_toll", "k_m", "k_s"]


def bundles(search: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Bundles of weightings with a column for each lane's factors, the lane of each search, and the number of lanes."""
    most = search.groupBy("origin_id", "vehicle_class").count().agg(F.max("count")).first()[0] or 1
    lanes = -(-most // -(-most // LANES))
    number = F.row_number().over(Window.partitionBy("origin_id", "vehicle_class").orderBy("mode")) - 1
    laned = search.withColumn("_n", number).withColumns({"bundle": F.floor(F.col("_n") / lanes).cast("int"), "lane": F.col("_n") % lanes})
    of = lambda k, c: F.max(F.when(F.col("lane") == k, F.col(c))).alias(f"{c}_{k}")
    wide = laned.groupBy(*BUNDLE).agg((F.max("lane") + 1).alias("used"), *(of(k, c) for k in range(lanes) for c in FACTORS))
    return written(wide, "bundles"), written(laned.select(*BUNDLE, "lane", *[c for c in search.columns if c not in BUNDLE]), "lanes"), lanes


def lane_cost(k: int, toll, metres, seconds):
    """What a way costs in lane k."""
    return F.col(f"k_toll_{k}") * toll + F.col(f"k_m_{k}") * metres + F.col(f"k_s_{k}") * seconds


def weightings(search: DataFrame) -> list[tuple]:
    """The different (class, factors) of all searches: few, however many origins there are."""
    return sorted(tuple(r) for r in search.select("vehicle_class", *FACTORS).distinct().collect())


def near_moves(moves: DataFrame, left: dict[tuple, tuple[float, float]], moves_cost: bool = True) -> DataFrame:
    """vehicle_class, node, to_node, kind, e_s, e_m, toll of the moves that a class can make and some weighting of it can use.

    left: by (class, factors) what a move onto the toll side and any other may cost at most. moves_cost: no toll is below zero.
    """
    by_class: dict[int, list[tuple]] = {}
    for (kind, *factors), most in left.items():
        by_class.setdefault(int(kind), []).append((*factors, *most))
    kinds = sorted(by_class)
    shape = pa.schema([("vehicle_class", pa.int32()), ("node", pa.int64()), ("to_node", pa.int64()), ("kind", pa.int32()), ("e_s", pa.float64()), ("e_m", pa.float64()), ("toll", pa.float64())])

    def near(batches):
        for b in batches:
            e_s, e_m, to_node = (b[c].to_numpy(zero_copy_only=False) for c in ("e_s", "e_m", "to_node"))
            tolled = to_node % 2 == 1
            sizes = pc.list_value_length(b["tolls"])
            for kind in kinds:
                lists = b["tolls"] if (pc.min(sizes).as_py() or 0) >= kind else pc.if_else(pc.less(sizes, kind), None, b["tolls"])
                toll = pc.list_element(lists, kind - 1).to_numpy(zero_copy_only=False)
                keep = np.zeros(len(toll), bool)
                with np.errstate(invalid="ignore"):
                    for k_toll, k_m, k_s, onto_toll, other in by_class[kind]:
                        keep |= k_toll * toll + k_m * e_m + k_s * e_s <= np.where(tolled, onto_toll, other)
                at = np.flatnonzero(keep & np.isfinite(toll) & np.isfinite(e_m) & np.isfinite(e_s))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), kind, np.int32)), *(b[c].take(pa.array(at)) for c in ("node", "to_node", "kind")), pa.array(e_s[at]), pa.array(e_m[at]), pa.array(toll[at])], schema=shape
                    )

    # no part of a weight exceeds it: most moves are too long or too slow for every weighting and stay with Spark
    far = sorted([max(most) / k if k > 0 else float("inf") for k in (k_m, k_s)] for (_, _, k_m, k_s), most in left.items())
    alike = [far[i : i + -(-len(far) // FAR_GROUPS)] for i in range(0, len(far), max(1, -(-len(far) // FAR_GROUPS)))]
    if moves_cost and all(min(x) < float("inf") for x in far):
        moves = moves.where(reduce(or_, ((F.col("e_m") <= max(m for m, _ in g)) & (F.col("e_s") <= max(s for _, s in g)) for g in alike), F.lit(False)))
    ways = [F.coalesce(c, F.lit(float("inf"))).alias(c) for c in ("e_s", "e_m")]
    rows = moves.select(F.col("node").cast("bigint").alias("node"), F.col("to_node").cast("bigint").alias("to_node"), F.col("kind").cast("int").alias("kind"), *ways, "tolls")
    return rows.mapInArrow(near, "vehicle_class int, node bigint, to_node bigint, kind int, e_s double, e_m double, toll double")


def ways_in_tasks(lanes: DataFrame, entry: DataFrame, exits: DataFrame, asked: DataFrame, near: DataFrame) -> DataFrame:
    """Ways to all asked destinations: the origins of a class in a few parts, each beside the class's near moves.

    lanes: origin_id, vehicle_class, mode, factors and bound of every search.
    """
    spark, own = near.sparkSession, ["origin_id", "vehicle_class"]
    modes = lanes.groupBy(*own).agg(F.collect_list(F.struct("mode", *FACTORS, "bound")).alias("modes"))
    entries = entry.groupBy("origin_id").agg(F.collect_list(F.struct("node", "m", "s")).alias("entries"))
    leave = asked.join(exits, "destination_id").groupBy(*own).agg(F.collect_list(F.struct("destination_id", "node", "x_m", "x_s")).alias("exits"))
    size = lanes.agg(F.countDistinct("vehicle_class").alias("classes"), F.max("vehicle_class").alias("most"), F.countDistinct("origin_id").alias("origins")).first()
    parts = max(1, min(size["origins"], -(-2 * spark.sparkContext.defaultParallelism // max(1, size["classes"]))))
    ids = F.array(*(F.lit(i) for i in numbers_apart(spark, parts * (size["most"] or 1))))
    block = lambda part: ids[((F.col("vehicle_class") - 1) * parts + part).cast("int")].alias("block")
    left = modes.join(entries, "origin_id").join(leave, own).select("*", block(F.pmod(F.col("origin_id"), F.lit(parts))))
    right = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("*", block(F.col("part"))).drop("part", "vehicle_class")

    def search(searches: pa.Table, moves: pa.Table) -> pa.Table:
        return cheapest_ways(searches, moves) if searches.num_rows and moves.num_rows else FOUND.empty_table()

    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(search, FOUND_SQL)


def route_table(groups: DataFrame, classes: DataFrame, legs: DataFrame, moves: DataFrame) -> DataFrame:
    """Best route per (search, destination): totals, path of steps, length of the last leg.

    `legs` are access legs (hub_id, gare_id, direction, duration_s, distance_m); `moves` the folded
    graph, read a few times and never exchanged as a whole. An unreachable destination has no row.

    Every route enters, makes a toll move or more, and leaves. Routes of a single toll move tell, before the search,
    what no destination costs more than; with the least entry, exit and toll move that leaves so little for any one move that
    only the near ones of a class are searched, in tasks that hold them; very many are searched round by round.
    """
    search = written(searches(groups, classes), "searches")
    goal = written(targets(groups, search), "targets")
    wide, laned, lanes = bundles(search)
    factors = {f"{c}_{k}": F.coalesce(f"{c}_{k}", F.lit(0.0)) for k in range(lanes) for c in FACTORS}
    wide = wide.withColumns(factors)
    context = wide.drop("used")
    # Exit legs are shaped by gate once and read in every round.
    exits = written(
        legs.where("direction = 'exit'").select(
            (F.col("gare_id") * 2 + 1).alias("node"), F.col("hub_id").alias("destination_id"),
            F.col("duration_s").alias("x_s"), F.col("distance_m").alias("x_m"),
        ),
        "exits",
    )
    asked = groups.where("origin_id <> destination_id").select("origin_id", "vehicle_class", "destination_id").distinct()
    aims = written(wide.select(*BUNDLE).join(asked, ["origin_id", "vehicle_class"]).join(exits.select("destination_id").distinct(), "destination_id", "left_semi"), "aims")
    entry = written(
        legs.where("direction = 'entry'").select(
            F.col("hub_id").alias("origin_id"), (F.col("gare_id") * 2).alias("node"),
            (F.col("duration_s") + DWELL_S).alias("s"), (F.col("distance_m") + DWELL_M).alias("m"),
        ),
        "entries",
    )
    zero = F.lit(0.0)
    each = range(lanes)
    enter = lambda k: F.when(F.col("used") > k, lane_cost(k, zero, F.col("m"), F.col("s")))
    seeds = wide.join(entry, "origin_id").select(*BUNDLE, "node", *(enter(k).alias(f"c{k}") for k in each))
    leg = lambda k: lane_cost(k, zero, F.col("x_m"), F.col("x_s"))
    leave = lambda k: F.col(f"c{k}") + leg(k)
    onward = lambda k: lane_cost(k, F.col("toll"), F.col("e_m"), F.col("e_s"))
    exit_least = aims.join(exits, "destination_id").join(wide, BUNDLE).groupBy(*BUNDLE).agg(*(F.min(leg(k)).alias(f"x{k}") for k in each))
    least = written(exit_least.join(seeds.groupBy(*BUNDLE).agg(*(F.min(f"c{k}").alias(f"i{k}") for k in each)), BUNDLE), "least-legs")
    met: list[DataFrame] = []  # costs at destinations: the least so far, then those of the rounds since

    def dearest() -> DataFrame:
        """Cost of the dearest destination in each lane, once all are met."""
        every = met[0]
        for m in met[1:]:
            every = every.unionByName(m)
        met[:] = [written(every.groupBy(*BUNDLE, "destination_id").agg(*(F.min(f"c{k}").alias(f"c{k}") for k in each)), "met")]
        all_met = (F.when(F.count(f"c{k}") == F.count(F.lit(1)), F.max(f"c{k}")).alias(f"d{k}") for k in each)
        return aims.join(met[0], [*BUNDLE, "destination_id"], "left").groupBy(*BUNDLE).agg(*all_met).join(least, BUNDLE)

    slack = lambda k: F.abs(f"d{k}") * 1e-9 + 1e-6  # against rounding
    bounds: list[DataFrame] = []

    def limit(improved: DataFrame, due: bool) -> DataFrame:
        """What a row may have cost at most, for there is an exit to come; from the improved rows alone."""
        found = improved.join(exits, "node").join(wide, BUNDLE)
        met.append(found.select(*BUNDLE, "destination_id", *(leave(k).alias(f"c{k}") for k in each)))
        if due:
            bounds[:] = [written(dearest().select(*BUNDLE, *((F.col(f"d{k}") - F.col(f"x{k}") + slack(k)).alias(f"b{k}") for k in each)), "bounds")]
        return bounds[0]

    onto_toll = moves.where("to_node % 2 = 1")
    kinds = weightings(search)
    most_class = max((int(w[0]) for w in kinds), default=0)
    tolls = [F.element_at("tolls", k) for k in range(1, most_class + 1)]
    of = lambda f: F.struct(f("e_m").alias("m"), f("e_s").alias("s"), F.array(*(f(t) for t in tolls)).alias("tolls"))
    stats = onto_toll.agg(of(F.min).alias("least"), of(F.avg).alias("mean")).first()
    priced = lambda w, v: w[1] * (v["tolls"][int(w[0]) - 1] or 0.0) + w[2] * (v["m"] or 0.0) + w[3] * (v["s"] or 0.0)
    toll_least = {w: priced(w, stats["least"]) for w in kinds}
    moves_cost = all((t or 0.0) >= 0 for t in stats["least"]["tolls"])
    endless = float("inf")

    def left_for_moves(share: float) -> dict[tuple, tuple[float, float]]:
        """By weighting, what is left for a toll move and for another; endless where not all destinations are met by single toll moves."""
        some = {w: (endless if share == endless else toll_least[w] + share * (priced(w, stats["mean"]) - toll_least[w]), -endless) for w in kinds}
        single = near_moves(onto_toll, some, moves_cost).join(entry, "node").join(exits.withColumnRenamed("node", "to_node"), "to_node")
        single = single.join(asked, ["origin_id", "destination_id", "vehicle_class"]).join(wide, ["origin_id", "vehicle_class"])
        met[:] = [single.groupBy(*BUNDLE, "destination_id").agg(*(F.min(enter(k) + onward(k) + leg(k)).alias(f"c{k}") for k in each))]
        return left_of_met()

    def left_of_met() -> dict[tuple, tuple[float, float]]:
        lane = F.array(*(F.struct(F.lit(k).alias("lane"), (F.coalesce(f"d{k}", F.lit(endless)) - F.col(f"i{k}") - F.col(f"x{k}") + F.coalesce(slack(k), zero)).alias("left")) for k in each))
        rows = dearest().select(*BUNDLE, F.explode(lane).alias("v")).select(*BUNDLE, "v.*").join(laned, [*BUNDLE, "lane"])
        rows = rows.groupBy("vehicle_class", *FACTORS).agg(F.max(F.coalesce("left", F.lit(endless)))).collect()
        left = {tuple(r)[:4]: r[4] for r in rows}
        return {w: (left[w], left[w] - toll_least[w]) for w in kinds if w in left}

    def ways_by_rounds(near: DataFrame | None) -> DataFrame:
        """Ways of the wanted destinations, round by round over the near moves, or block by block over all where none are known to be near."""
        blocks = None
        if near is None:
            size = moves.agg(F.count(F.lit(1)).alias("moves"), F.countDistinct("to_node").alias("nodes")).first()
            blocks = Blocks(BUNDLE, lanes, FACTORS, size["moves"], size["nodes"], wide)
            table, on = written(moves, "moves"), ["node"]
            toll = F.coalesce(F.element_at("tolls", F.col("vehicle_class").cast("int")), F.lit(endless))
            step = lambda k: F.when(toll < endless, lane_cost(k, toll, F.coalesce("e_m", F.lit(endless)), F.coalesce("e_s", F.lit(endless)))).otherwise(endless)
        else:
            table, on, toll, step = near, ["vehicle_class", "node"], F.col("toll"), onward
        state = relax(seeds, table, BUNDLE, step, lanes, context=context, on=on, limit=limit, blocks=blocks)
        last = lambda k: F.min(F.when(leave(k).isNotNull(), F.struct(leave(k).alias("cost"), "node", F.col("x_m").alias("last_m"), F.col("x_s").alias("last_s"))))
        ends = state.join(exits, "node").join(wide, BUNDLE).join(aims, [*BUNDLE, "destination_id"], "left_semi")
        ends = ends.groupBy(*BUNDLE, "destination_id").agg(F.array(*(last(k) for k in each)).alias("r"))
        best = ends.select(*BUNDLE, "destination_id", F.posexplode("r").alias("lane", "r")).where("r is not null").select(*BUNDLE, "destination_id", "lane", "r.*")
        best = written(best.join(laned, [*BUNDLE, "lane"]).join(goal, [*SEARCH, "destination_id"], "left_semi"), "ends")
        carry = {"toll": toll, "e_m": F.col("e_m"), "e_s": F.col("e_s")}
        links = ways_back(best.select(*BUNDLE, "lane", "node"), state, table, BUNDLE, step, lanes, context=context, on=on, carry=carry)
        links = written(links, "ways-back")
        walked = walk(best.select(*BUNDLE, "lane", "node"), links, BUNDLE, tuple(carry))
        return best.join(walked, [*BUNDLE, "lane", "node"]).select(*SEARCH, "destination_id", "last_m", "last_s", "path")

    left = left_for_moves(FIRST_SHARE)
    if any(v[0] == endless for v in left.values()):
        left = left_for_moves(endless)
    bound = F.array(*(F.struct(F.lit(k).alias("lane"), (F.col(f"d{k}") + slack(k)).alias("bound")) for k in each))
    capped = lambda: laned.join(dearest().select(*BUNDLE, F.explode(bound).alias("v")).select(*BUNDLE, "v.*"), [*BUNDLE, "lane"], "left")
    few = lambda df: (df.groupBy("vehicle_class").count().agg(F.max("count")).first()[0] or 0) <= NEAR_MOST
    if left and all(v[0] < endless for v in left.values()):
        # ways of the very near moves alone cost hardly more than the cheapest ones: tighter bounds, and fewer near moves
        nearer = {w: (toll_least[w] + NEARER * (v[0] - toll_least[w]), NEARER * v[1]) for w, v in left.items()}
        nearest = written(near_moves(moves, nearer, moves_cost), "nearest-moves")
        if few(nearest):
            rough = ways_in_tasks(capped(), entry, exits, asked, nearest).select(*SEARCH, "destination_id", "cost").join(laned, SEARCH)
            met.append(rough.groupBy(*BUNDLE, "destination_id").agg(*(F.min(F.when(F.col("lane") == k, F.col("cost"))).alias(f"c{k}") for k in each)))
            left = left_of_met()
    near = None
    if all(v[0] < endless for v in left.values()) or moves.count() <= BLOCKS_FROM:
        near = written(near_moves(moves, left, moves_cost), "near-moves")
    if near is not None and few(near):
        found = ways_in_tasks(capped(), entry, exits, asked, near).drop("cost")
        found = written(found.join(goal, [*SEARCH, "destination_id"], "left_semi"), "ways")
    else:
        found = ways_by_rounds(near)
    seed = entry.withColumnRenamed("node", "_seed")
    found = found.withColumn("_seed", F.col("path")[0]["node"]).join(seed, ["origin_id", "_seed"])
    sums = lambda first, name: F.aggregate(F.slice("path", 2, F.size("path")), first, lambda t, v: t + v[name])
    steps = F.transform("path", lambda v: F.floor(v["node"] / 2) * 8 + F.coalesce(v["kind"], F.lit(ENTRY)))
    found = found.select(
        *SEARCH, "destination_id", sums(zero, "toll").alias("toll"), (sums(F.col("m"), "e_m") + F.col("last_m")).alias("distance_m"),
        (sums(F.col("s"), "e_s") + F.col("last_s")).alias("duration_s"), (F.size("path") - 1).alias("hops"), steps.alias("path"), "last_m",
    )
    stay = groups.where("origin_id = destination_id").select("origin_id", "vehicle_class", "destination_id").distinct()
    home = search.join(stay, ["origin_id", "vehicle_class"]).select(
        *SEARCH, "destination_id", *[zero.alias(c) for c in ("toll", "distance_m", "duration_s")],
        F.lit(0).alias("hops"), F.array().cast("array<bigint>").alias("path"), zero.alias("last_m"),
    )
    priced = found.unionByName(home).join(search, SEARCH)
    return priced.withColumn("cost", weighted(F.col("toll"), F.col("distance_m"), F.col("duration_s"))).drop("k_toll", "k_m", "k_s")
