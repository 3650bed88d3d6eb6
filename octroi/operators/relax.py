"""Many shortest-path searches in one iterative DataFrame job, several weightings a row.

A state row is a (search, node) with one cost column for each of the search's lanes (weightings) and the round
in which that cost was found. A round joins the rows improved last to the moves, takes the least candidate of
each lane in one hash aggregation (all columns are primitive, so it combines on the map side), and looks these
up in the state: only improvements are written. The state lies in fixed buckets by (search, node), beside the
improvements of the last few rounds, so a round exchanges the frontier, its candidates and these improvements
and never the state; they are folded into it when they have grown to a quarter of it.

Costs are replaced only by lesser ones, so of ways of equal cost the one of the fewest moves stays. No way is
carried along: a row's last move is the one whose start has, in its lane, exactly the cost that with the move's
own gives the row's, of the fewest moves, then of the least `via` = node * 8 + kind. `ways_back` finds
these moves for the wanted rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octroi.operators.blocks import Blocks
from octroi.session import bucketed, written

FAN_ROWS = 50_000
#: Improvements are folded into the state once they have this share of its rows …
FOLD_AT = 0.25
#: … or is made of so many rounds' improvements.
FOLD_TABLES = 6

#: Increment of lane k over a joined (state, context, move) row; null where the move can't be used.
Increment = Callable[[int], Column]


def costs(lanes: int) -> list[str]:
    return [f"c{k}" for k in range(lanes)]


def rounds(lanes: int) -> list[str]:
    return [f"h{k}" for k in range(lanes)]


def fan_out(moves: DataFrame, on: list[str], rows: int = FAN_ROWS) -> DataFrame:
    """Spreads the moves of a hot node over several join keys.

    `fan` is the number of salts of the node a move leads to, `salt` the salt of the move itself.
    States carry `fan` and visit every salt, so nothing is lost.
    """
    others = [c for c in on if c != "node"]
    degree = moves.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_f"))
    target = degree.withColumnRenamed("node", "to_node").withColumnRenamed("_f", "fan")
    return (
        moves.join(degree, on)
        .withColumn("salt", F.pmod(F.xxhash64("to_node", "kind"), F.col("_f")).cast("int"))
        .drop("_f")
        .join(target, [*others, "to_node"], "left")
        .withColumn("fan", F.coalesce("fan", F.lit(0)))
    )


def relax(
    seeds: DataFrame,
    moves: DataFrame,
    keys: list[str],
    increment: Increment,
    lanes: int = 1,
    context: DataFrame | None = None,
    on: list[str] | None = None,
    limit: Callable[[DataFrame, bool], DataFrame | None] | None = None,
    capped: bool = False,
    fan_rows: int = FAN_ROWS,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Least cost from the seeds to every reachable node: keys, node, c0 …, h0 … (moves made).

    seeds: keys, node and c0 … (null: the lane doesn't start there). moves: node, to_node, kind (0..7)
    and what the increments need. `context` holds per-search constants by `keys`. `on` names the columns
    that tie a state to its moves. `limit(improved, due)` is told of all improvements, and gives (keys, b0 …): costs
    above it can lead nowhere that matters, and are dropped; it need look anew only where `due`. capped: the context
    itself holds b0 …, for good. blocks: a round's candidates are found block by block, from the lanes' factors in the
    context, in place of `increment`.
    """
    on = on or ["node"]
    c, h, row = costs(lanes), rounds(lanes), [*keys, "node"]
    fanned = written(fan_out(moves, on, fan_rows), "fanned") if blocks else fan_out(moves, on, fan_rows)
    table = blocks.dealt(fanned) if blocks else bucketed(fanned, "moves", [*on, "salt"])[0]
    degree = (fanned if blocks else table).groupBy(*on).agg((F.max("salt") + 1).alias("fan"))
    none = F.coalesce(*c).isNull()
    start = seeds.groupBy(*row).agg(*(F.min(k).alias(k) for k in c)).where(~none).join(degree, on, "left").withColumn("fan", F.coalesce("fan", F.lit(0)))
    improved = written(start, "frontier")
    at_round = lambda df, n: df.select(*row, *c, *(F.when(F.col(k).isNotNull(), n).alias(g) for k, g in zip(c, h, strict=True)))
    (state, plain), recent, n = bucketed(at_round(improved, 0), "state", row), [], 0
    size = improved.agg(F.count("*").alias("rows"), F.count_if(F.col("fan") > 0).alias("front")).first()
    state_rows, recent_rows, bounds = size["rows"], 0, None
    most = F.lit(float("inf"))

    def together(parts: list[DataFrame]) -> DataFrame:
        """A later cost of a row is always less than its earlier ones."""
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy(*row).agg(*(F.min(k).alias(k) for k in c), *(F.max(g).alias(g) for g in h))

    while size["front"]:
        if limit is not None:
            bounds = limit(improved, n & (n - 1) == 0)  # bounds only get tighter, so older ones hold too
        n += 1
        front, bounded = improved.where("fan > 0"), capped or bounds is not None
        constants = bounds if context is None else context if bounds is None else context.join(bounds, keys, "left")
        visits = front.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
        if constants is not None:
            visits = visits.join(constants, keys, "left")
        if bounded:
            visits = visits.withColumns({k: F.when(F.col(k) <= F.coalesce(f"b{i}", most), F.col(k)) for i, k in enumerate(c)}).where(~none)
        # without nulls the lanes' arithmetic is short enough to be compiled as a whole, however many there are
        visits = visits.withColumns({k: F.coalesce(k, most) for k in c})
        reached = blocks.reached(visits, table) if blocks else visits.join(table, [*on, "salt"]).select(
            *keys, F.col("to_node").alias("node"), *((F.col(k) + increment(i)).alias(f"n{i}") for i, k in enumerate(c)), "fan",
            *(f"b{k}" for k in range(lanes) if bounded),
        )
        if bounded and not blocks:  # what no lane can use isn't exchanged
            within = [F.col(f"n{k}") <= F.coalesce(f"b{k}", most) for k in range(lanes)]
            reached = reached.where(reduce(or_, within)).drop(*(f"b{k}" for k in range(lanes)))
        found = reached.groupBy(*row).agg(*(F.min(f"n{k}").alias(f"n{k}") for k in range(lanes)), F.max("fan").alias("fan"))
        known = [state.select(*row, *(F.col(k).alias(f"s{k}") for k in c))]
        if recent:
            known.append(together(recent).select(*row, *(F.col(k).alias(f"r{k}") for k in c)))
        if bounded:
            known.append(constants.select(*keys, *(f"b{k}" for k in range(lanes))))
        for k in known:
            found = found.join(k, [x for x in row if x in k.columns], "left")
        better = []
        for k in range(lanes):  # what isn't a number is not less
            old = F.least(most, *(F.coalesce(x, most) for x in (f"sc{k}", f"rc{k}") if x in found.columns))
            fits = F.col(f"n{k}") < old
            if bounded:
                fits = fits & (F.col(f"n{k}") <= F.coalesce(f"b{k}", most))
            better.append(F.when(fits, F.col(f"n{k}")).alias(c[k]))
        improved = written(found.select(*row, *better, "fan").where(~none), "frontier")
        size = improved.agg(F.count("*").alias("rows"), F.count_if(F.col("fan") > 0).alias("front")).first()
        recent.append(at_round(improved, n))
        recent_rows += size["rows"]
        if recent_rows > FOLD_AT * state_rows or len(recent) >= FOLD_TABLES:
            (state, plain), recent = bucketed(together([plain, *recent]), "state", row), []
            state_rows, recent_rows = plain.count(), 0
    return together([plain, *recent]) if recent else plain


def of_lane(names: list[str], lane: str = "lane") -> Column:
    """The value of the lane that the row names, from its columns for all lanes."""
    return F.array(*names)[F.col(lane)]


def ways_back(
    wanted: DataFrame,
    state: DataFrame,
    moves: DataFrame,
    keys: list[str],
    increment: Increment,
    lanes: int = 1,
    context: DataFrame | None = None,
    on: list[str] | None = None,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """The last move of every row on the way to a wanted one: keys, lane, node, prev, kind, `carry` of the move's row.

    wanted: keys, node, lane. Rows are looked at once each however many ways pass them; rows at a seed
    have no last move.
    """
    on, carry = on or ["node"], carry or {}
    others = [x for x in on if x != "node"]
    at = [*keys, "lane", "node"]
    values = state.select(*keys, "node", *costs(lanes), *rounds(lanes))
    rows = wanted.select(*at).distinct().join(values, [*keys, "node"])
    rows = rows.select(*at, of_lane(costs(lanes)).alias("cost"), of_lane(rounds(lanes)).alias("moves")).where("moves > 0")
    arrivals = moves.withColumnRenamed("node", "from_node").withColumnRenamed("to_node", "node").select(*others, "node", "from_node", *(x for x in moves.columns if x not in ("node", "to_node", *others)))
    start = values.withColumnRenamed("node", "from_node")
    links: list[DataFrame] = []
    while True:
        here = rows if context is None else rows.join(context, keys)
        met = here.join(arrivals, [*others, "node"]).join(start, [*keys, "from_node"])
        before, step = of_lane(costs(lanes)), F.array(*(increment(k) for k in range(lanes)))[F.col("lane")]
        best = F.min(F.struct(of_lane(rounds(lanes)).alias("before_moves"), (F.col("from_node") * 8 + F.col("kind")).alias("via"), before.alias("before"), *(x.alias(name) for name, x in carry.items())))
        link = met.where(before + step == F.col("cost")).groupBy(*at).agg(best.alias("m"))
        link = written(link.select(*at, F.floor(F.col("m.via") / 8).alias("prev"), F.pmod(F.col("m.via"), F.lit(8)).cast("int").alias("kind"), "m.*"), "links")
        if link.isEmpty():
            break
        links.append(link.select(*at, "prev", "kind", *carry))
        rows = link.where("before_moves > 0").select(*keys, "lane", F.col("prev").alias("node"), F.col("before").alias("cost"), F.col("before_moves").alias("moves")).distinct()
        for known in links:
            rows = rows.join(known.select(*at), at, "left_anti")
    if not links:
        return link.select(*at, "prev", "kind", *carry)
    every = links[0]
    for link in links[1:]:
        every = every.unionByName(link)
    return every


def walk(heads: DataFrame, links: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, lane, node, path for each of `heads` (keys, lane, node): array<struct<node, kind, carry…>> from the seed on.

    Pointers are doubled: rows that know where they are after 2^k moves back reach 2^(k+1), and those that
    have met their seed leave. What was visited is gathered once, at the end. kind is null at the seed.
    """
    at = [*keys, "lane", "node"]
    jump = links.select(*at, F.col("prev").alias("up"))
    seen = [written(heads.select(*at).distinct().withColumns({"head": F.col("node"), "back": F.lit(0)}), "walk")]
    size = 1
    while not jump.isEmpty():
        every = seen[0]
        for s in seen[1:]:
            every = every.unionByName(s)
        seen.append(written(every.join(jump, at).select(*keys, "lane", F.col("up").alias("node"), "head", (F.col("back") + size).alias("back")), "walk"))
        further = jump.select(*keys, "lane", F.col("node").alias("up"), F.col("up").alias("beyond"))
        jump = written(jump.join(further, [*keys, "lane", "up"]).select(*at, F.col("beyond").alias("up")), "jump")
        size *= 2
    every = seen[0]
    for s in seen[1:]:
        every = every.unionByName(s)
    step = F.struct((-F.col("back")).alias("back"), "node", "kind", *carry)
    path = F.transform(F.array_sort(F.collect_list(step)), lambda v: F.struct(v["node"].alias("node"), v["kind"].alias("kind"), *(v[x].alias(x) for x in carry)))
    return every.join(links.drop("prev"), at, "left").groupBy(*keys, "lane", "head").agg(path.alias("path")).withColumnRenamed("head", "node")
