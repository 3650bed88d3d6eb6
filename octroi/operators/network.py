"""The directed overlay graph as two tables.

Every gate has four nodes; a node key packs `gare_id * 4 + role`. A toll edge leaves OUT and lands on
IN_TOLL, so two fares can only be chained through a free leg, never through a dwell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.functions.pricing import fallback_seconds
from octroi.operators.cleaning import long_zero_drop, usable_fares
from octroi.operators.matrix import matrix_lookup
from octroi.session import written

IN, OUT, IN_TOLL, OUT_TOLL = 0, 1, 2, 3
ROLE_NAMES = ("in", "out", "in_toll", "out_toll")
DWELL_S, DWELL_M = 180.0, 500.0
CLASSES = tuple(f"class{k}" for k in range(1, 6))
# Order in which edge kinds are laid down; a later edge replaces an earlier one between two nodes.
EDGE_ORDER = {"dwell": 0, "toll": 1, "toll_free": 2, "boundary": 3, "exit_reentry": 4, "access": 5}


def node(gate, role: int):
    gate = F.col(gate) if isinstance(gate, str) else gate
    return gate * 4 + F.lit(role)


def _edge(df: DataFrame, kind: str, src, dst, duration, distance, operator=None, tolls: bool = False, seq=None) -> DataFrame:
    no_price = F.lit(None).cast("double")
    return df.select(
        src.alias("from_node"), dst.alias("to_node"), F.lit(kind).alias("edge_type"),
        duration.cast("double").alias("duration_s"), distance.cast("double").alias("distance_m"),
        (operator if operator is not None else F.lit(None).cast("string")).alias("operator"),
        *[(F.col(c) if tolls else no_price).alias(c) for c in CLASSES],
        (seq if seq is not None else F.lit(0)).cast("bigint").alias("seq"),
    )


def graph_nodes(active: DataFrame) -> DataFrame:
    roles = F.array(*[F.struct(F.lit(i).alias("role_id"), F.lit(n).alias("role")) for i, n in enumerate(ROLE_NAMES)])
    return active.select("gare_id", F.explode(roles).alias("r")).select(
        (F.col("gare_id") * 4 + F.col("r.role_id")).alias("node"), "gare_id", F.col("r.role").alias("role")
    )


def edges_dwell(active: DataFrame) -> DataFrame:
    sides = active.select("gare_id", F.explode(F.array(F.lit(IN), F.lit(IN_TOLL))).alias("role"))
    src = F.col("gare_id") * 4 + F.col("role")
    return _edge(sides, "dwell", src, src + 1, F.lit(DWELL_S), F.lit(DWELL_M))


def _between_active(fares: DataFrame, active: DataFrame) -> DataFrame:
    ids = active.select("gare_id")
    return (
        usable_fares(fares)
        .join(ids.withColumnRenamed("gare_id", "from_gare_id"), "from_gare_id", "left_semi")
        .join(ids.withColumnRenamed("gare_id", "to_gare_id"), "to_gare_id", "left_semi")
    )


def edges_selfloop(fares: DataFrame, active: DataFrame) -> DataFrame:
    """Flat fees: a priced edge at one gate, without time or distance."""
    own = _between_active(fares, active).where("from_gare_id = to_gare_id")
    return _edge(
        own, "toll", node("from_gare_id", OUT), node("to_gare_id", IN_TOLL), F.lit(0.0), F.lit(0.0),
        F.col("operator"), True, F.col("row_id"),
    )


def _tolled_fares(fares: DataFrame, active: DataFrame, points: DataFrame, matrix: DataFrame) -> DataFrame:
    """Usable fares between two gates with the points of these and `edge_s`, `edge_m`: the tolled leg or, lacking one, the stated distance."""
    rows = long_zero_drop(_between_active(fares, active).where("from_gare_id <> to_gare_id"))
    legs = matrix_lookup(rows, points, matrix).where("from_pid IS NOT NULL AND to_pid IS NOT NULL")
    # A pair at one place is the matrix diagonal: no distance.
    same = F.col("from_pid") == F.col("to_pid")
    missing = F.col("tolled_s").isNull() | F.col("tolled_m").isNull()
    stated = F.coalesce("distance_km", F.lit(0.0)) * 1000.0
    distance = F.when(same, F.lit(0.0)).when(missing, stated).otherwise(F.col("tolled_m"))
    duration = F.when(same, F.lit(0.0)).when(missing, fallback_seconds(stated)).otherwise(F.col("tolled_s"))
    return legs.withColumns({"edge_s": duration, "edge_m": distance})


def _toll_edge(legs: DataFrame) -> DataFrame:
    return _edge(
        legs, "toll", node("from_gare_id", OUT), node("to_gare_id", IN_TOLL), F.col("edge_s"), F.col("edge_m"),
        F.col("operator"), True, F.col("row_id"),
    )


def edges_toll(fares: DataFrame, active: DataFrame, points: DataFrame, matrix: DataFrame) -> DataFrame:
    """One edge per usable fare between two gates, with the tolled leg or, lacking one, the stated distance."""
    return _toll_edge(_tolled_fares(fares, active, points, matrix))


def dense_pairs(active: DataFrame, points: DataFrame, matrix: DataFrame) -> DataFrame:
    """Ordered active gate pairs between different places that have a toll-free leg; driven by the matrix rows."""
    ids = points.join(active.select("gare_id"), "gare_id", "left_semi")
    legs = matrix.where("from_pid <> to_pid AND free_s IS NOT NULL AND free_m IS NOT NULL").select("from_pid", "to_pid", "free_s", "free_m")
    return (
        legs.join(ids.select(F.col("pid").alias("from_pid"), F.col("gare_id").alias("from_gare_id")), "from_pid")
        .join(ids.select(F.col("pid").alias("to_pid"), F.col("gare_id").alias("to_gare_id")), "to_pid")
        .select("from_gare_id", "to_gare_id", "free_s", "free_m")
    )


def _both_sides(df: DataFrame) -> DataFrame:
    return df.withColumn("role", F.explode(F.array(F.lit(OUT), F.lit(OUT_TOLL))))


def edges_free(active: DataFrame, points: DataFrame, matrix: DataFrame) -> DataFrame:
    rows = _both_sides(dense_pairs(active, points, matrix))
    return _edge(
        rows, "toll_free", F.col("from_gare_id") * 4 + F.col("role"), node("to_gare_id", IN), F.col("free_s"), F.col("free_m")
    )


def edges_transfer(transfers: DataFrame, active: DataFrame) -> DataFrame:
    """Changes between close gates, both ways and from both sides: a boundary lands on OUT, a re-entry on IN."""
    ids = active.select("gare_id")
    rows = transfers.join(ids.withColumnRenamed("gare_id", "a_id"), "a_id", "left_semi").join(
        ids.withColumnRenamed("gare_id", "b_id"), "b_id", "left_semi"
    )
    ways = F.array(
        F.struct(F.col("a_id").alias("p"), F.col("b_id").alias("q")), F.struct(F.col("b_id").alias("p"), F.col("a_id").alias("q"))
    )
    rows = _both_sides(rows.withColumn("w", F.explode(ways)))
    boundary = F.col("transfer_type") == "boundary"
    dst = F.col("w.q") * 4 + F.when(boundary, F.lit(OUT)).otherwise(F.lit(IN))
    out = _edge(rows, "x", F.col("w.p") * 4 + F.col("role"), dst, F.col("dwell_s"), F.col("dwell_m"), F.col("transfer_type"))
    return out.withColumn("edge_type", F.col("operator")).withColumn("operator", F.lit(None).cast("string"))


def access_legs(access: DataFrame, anchors: DataFrame, active: DataFrame) -> DataFrame:
    """Hub legs to and from active gates with the anchor's apron added; a missing leg is left out."""
    a = anchors.select("gare_id", "direction", "apron_distance_m", "apron_duration_s")
    rows = access.join(active.select("gare_id"), "gare_id", "left_semi").where("duration_s IS NOT NULL AND distance_m IS NOT NULL")
    return rows.join(a, ["gare_id", "direction"], "left").select(
        "hub_id", "gare_id", "direction",
        (F.col("duration_s") + F.coalesce("apron_duration_s", F.lit(0.0))).alias("duration_s"),
        (F.col("distance_m") + F.coalesce("apron_distance_m", F.lit(0.0))).alias("distance_m"),
    )


def edges_access(legs: DataFrame) -> DataFrame:
    """Origin -> IN and OUT_TOLL -> destination; hubs take the negative node keys -2*hub-1 and -2*hub-2."""
    entry = F.col("direction") == "entry"
    hub = F.col("hub_id")
    src = F.when(entry, -2 * hub - 1).otherwise(node("gare_id", OUT_TOLL))
    dst = F.when(entry, node("gare_id", IN)).otherwise(-2 * hub - 2)
    return _edge(legs, "access", src, dst, F.col("duration_s"), F.col("distance_m"))


def edge_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def static_edges(gates: DataFrame, fares: DataFrame, active: DataFrame, points: DataFrame, matrix: DataFrame, transfers: DataFrame) -> DataFrame:
    return edge_union(
        edges_dwell(active),
        edges_selfloop(fares, active),
        edges_toll(fares, active, points, matrix),
        edges_free(active, points, matrix),
        edges_transfer(transfers, active),
    )


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"))


def edge_costs(edges: DataFrame) -> DataFrame:
    """One edge per node pair, the last laid wins, with km and hours worked out."""
    order = F.create_map(*[v for k, n in EDGE_ORDER.items() for v in (F.lit(k), F.lit(n))])
    body = F.struct("edge_type", "duration_s", "distance_m", "operator", *CLASSES)
    last = edges.groupBy("from_node", "to_node").agg(
        F.max(F.struct(order[F.col("edge_type")].alias("o"), "seq", body.alias("e"))).alias("m")
    )
    return edge_costs_of(last.select("from_node", "to_node", "m.e.*"))


def edge_costs_of(edges: DataFrame) -> DataFrame:
    """Edges, one per node pair, with km and hours worked out."""
    columns = ("from_node", "to_node", "edge_type", "duration_s", "distance_m", "operator", *CLASSES)
    return edges.select(*columns).withColumns({"km": F.col("distance_m") / 1000.0, "hours": F.col("duration_s") / 3600.0})


def static_costs(fares: DataFrame, active: DataFrame, points: DataFrame, matrix: DataFrame, transfers: DataFrame) -> DataFrame:
    """`edge_costs` of the static edges, without a grouping of all of them.

    Only fares end on IN_TOLL behind OUT: their last ones are found where fares met their leg, before anything else is
    exchanged. Toll-free legs are one per pair of nodes; only those between points that a transfer also joins meet others.
    """
    met = _tolled_fares(fares, active, points, matrix)
    body = F.struct("row_id", "edge_s", "edge_m", "operator", *CLASSES)
    last = met.groupBy("from_pid", "to_pid", "from_gare_id", "to_gare_id").agg(F.max(body).alias("m"))
    tolls = edge_costs_of(_toll_edge(last.select("from_gare_id", "to_gare_id", "m.*")))
    at = lambda side, name: points.select(F.col("gare_id").alias(side), F.col("pid").alias(name))
    one = transfers.select("a_id", "b_id").join(at("a_id", "from_pid"), "a_id").join(at("b_id", "to_pid"), "b_id").select("from_pid", "to_pid")
    crossed = written(one.union(one.select("to_pid", "from_pid")).distinct(), "crossed-points")
    mixed = edges_free(active, points, matrix.join(crossed, ["from_pid", "to_pid"], "left_semi"))
    alone = edges_free(active, points, matrix.join(crossed, ["from_pid", "to_pid"], "left_anti"))
    few = edge_union(edges_dwell(active), edges_selfloop(fares, active), mixed, edges_transfer(transfers, active))
    return edge_union(tolls, edge_costs_of(alone), edge_costs(few))


def chaining_violations(edges: DataFrame) -> DataFrame:
    """Broken landing rules, one row per rule with its count; all zero in a sound graph.

    The no-chaining rule is checked on distinct nodes: a dwell edge that starts where some toll edge
    ends and ends where some toll edge starts.
    """
    toll = edges.where("edge_type = 'toll'")
    ends = toll.select(F.col("to_node").alias("from_node")).distinct()
    starts = toll.select(F.col("from_node").alias("to_node")).distinct()
    dwell = edges.where("edge_type = 'dwell'").select("from_node", "to_node")
    chained = dwell.join(ends, "from_node", "left_semi").join(starts, "to_node", "left_semi")
    role = lambda c: F.pmod(F.col(c), F.lit(4))
    rules = {
        "toll_lands_elsewhere": (F.col("edge_type") == "toll") & ((role("to_node") != IN_TOLL) | (role("from_node") != OUT)),
        "free_lands_elsewhere": F.col("edge_type").isin("toll_free", "exit_reentry") & (role("to_node") != IN),
        "boundary_lands_elsewhere": (F.col("edge_type") == "boundary") & (role("to_node") != OUT),
    }
    counts = edges.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    other = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("s")).select("s.rule", "s.n")
    return chained.agg(F.lit("toll_dwell_toll").alias("rule"), F.count(F.lit(1)).alias("n")).unionByName(other)


# --- moves: the graph with its pass-through nodes folded away -----------------------------------

KIND = {"toll_free": 1, "exit_reentry": 2, "boundary": 3, "toll": 4, "entry": 5}


def moves(costs: DataFrame) -> DataFrame:
    """Edges between OUT and OUT_TOLL only.

    IN and IN_TOLL have a single way on, the dwell, so a leg that lands there takes the dwell along;
    that is exact and halves the rounds of a search. A state key is gate * 2 + (1 on the toll side);
    `kind` says how the gate was reached.
    """
    from_gate, to_gate = F.floor(F.col("from_node") / 4), F.floor(F.col("to_node") / 4)
    from_side = F.when(F.pmod(F.col("from_node"), F.lit(4)) == OUT_TOLL, 1).otherwise(0)
    kind = F.create_map(*[v for k, n in KIND.items() for v in (F.lit(k), F.lit(n))])[F.col("edge_type")]
    stays = F.col("edge_type") == "boundary"
    return costs.where(F.col("edge_type").isin("toll_free", "exit_reentry", "boundary", "toll")).select(
        (from_gate * 2 + from_side).alias("node"),
        (to_gate * 2 + (F.col("edge_type") == "toll").cast("int")).alias("to_node"),
        kind.alias("kind"),
        F.when(stays, F.col("duration_s")).otherwise(F.col("duration_s") + DWELL_S).alias("e_s"),
        F.when(stays, F.col("distance_m")).otherwise(F.col("distance_m") + DWELL_M).alias("e_m"),
        F.when(F.col("edge_type") == "toll", F.array(*CLASSES)).otherwise(F.array(*[F.lit(0.0)] * 5)).alias("tolls"),
    )
