"""Cheapest ways of many weightings over one class's moves, origin by origin, inside one task.

A task holds the near moves of a class once and searches its origins one after the other, so its memory is that of the
moves and of one row of costs. Nodes are taken up in the order of their cost, a little at a time, and the search ends
where not even the least exit leads to a destination that is still open. Costs are added in the order in which the
rounds of `relax` add them, and ways of equal cost are settled by its rule: fewest moves, then the least last move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Nodes whose costs lie within this share of what is left are taken up together.
STEP = 1 / 48
STRUCT = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("toll", pa.float64()), ("e_m", pa.float64()), ("e_s", pa.float64())])
FOUND = pa.schema([
    ("origin_id", pa.int64()), ("vehicle_class", pa.int32()), ("mode", pa.int64()), ("destination_id", pa.int64()),
    ("cost", pa.float64()), ("last_m", pa.float64()), ("last_s", pa.float64()), ("path", pa.list_(STRUCT)),
])
FOUND_SQL = "origin_id bigint, vehicle_class int, mode bigint, destination_id bigint, cost double, last_m double, last_s double, path array<struct<node:bigint,kind:int,toll:double,e_m:double,e_s:double>>"


def slack(cost: float) -> float:
    """Against rounding, where sums in another order are compared."""
    return abs(cost) * 1e-9 + 1e-6 if np.isfinite(cost) else 0.0


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each begin to its end, one range after the other."""
    n = end - begin
    return np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def least_costs(n: int, seeds: np.ndarray, costs: np.ndarray, graph, ends: np.ndarray, legs: np.ndarray, firsts: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Costs of all nodes that matter for the ends, and the seeds' own costs. graph: begin, end by node; to_node and weight by move.

    ends: exit nodes, grouped by destination, which begin at `firsts`; legs: their exits' costs. bound: what no destination costs more than.
    """
    begin, stop, to, weight = graph
    cost = np.full(n, np.inf)
    np.minimum.at(cost, seeds, costs)
    own, open_ = cost.copy(), np.isfinite(cost)
    least = legs.min()
    room = bound - least - own.min() if np.isfinite(bound) else weight.mean() if len(weight) else 0.0
    width = max(room, 0.0) * STEP
    while open_.any():
        at = np.flatnonzero(open_)
        here = cost[at]
        bound = min(bound, np.minimum.reduceat(cost[ends] + legs, firsts).max())
        most = bound - least + slack(bound)
        lowest = here.min()
        if lowest > most:
            break
        at = at[here <= lowest + width]
        open_[at] = False
        moves = ranges(begin[at], stop[at])
        found = np.repeat(cost[at], stop[at] - begin[at]) + weight[moves]
        better = (found < cost[to[moves]]) & (found <= most)
        target = to[moves[better]]
        np.minimum.at(cost, target, found[better])
        open_[target] = True
    return cost, own


def way_back(end: int, cost: np.ndarray, own: np.ndarray, into) -> list[tuple[int, int]]:
    """(node, move that reached it) from the seed to the end; the seed's move is -1. into: moves by node, their starts, weights and names."""
    begin, stop, moves, start, weight, name = into
    before, todo = {}, [end]
    while todo:
        v = todo.pop()
        if v in before:
            continue
        before[v] = []
        if cost[v] < own[v]:
            m = moves[begin[v] : stop[v]]
            m = m[cost[start[m]] + weight[m] == cost[v]]
            before[v] = [(int(start[i]), int(i)) for i in m]
            todo += [u for u, _ in before[v]]
    hops, level = {v: 0 for v, m in before.items() if not m}, True
    while level:
        level = {v: 1 + min(hops[u] for u, _ in m if u in hops) for v, m in before.items() if v not in hops and any(u in hops for u, _ in m)}
        hops |= level
    way, v = [], end
    while before[v]:
        u, move = min((x for x in before[v] if x[0] in hops), key=lambda x: (hops[x[0]], name[x[1]]))
        way.append((v, move))
        v = u
    return [*reversed([*way, (v, -1)])]


def cheapest_ways(searches: pa.Table, moves: pa.Table) -> pa.Table:
    """Way and last leg of every (origin, mode, destination) that can be reached.

    searches: a row for each origin of one class: modes (mode, k_toll, k_m, k_s, bound), entries (node, m, s) and exits
    (destination_id, node, x_m, x_s). moves: near moves of the class.
    """
    node, to_node, kind, toll, e_m, e_s = (moves[c].to_numpy() for c in ("node", "to_node", "kind", "toll", "e_m", "e_s"))
    nodes, place = np.unique(np.concatenate([node, to_node]), return_inverse=True)
    n, start, to = len(nodes), place[: len(node)].astype(np.int32), place[len(node) :].astype(np.int32)
    by_start, by_end = np.argsort(start, kind="stable"), np.argsort(to, kind="stable")
    counts = np.arange(n)
    out = [np.searchsorted(start[by_start], counts, s) for s in ("left", "right")]
    into = [np.searchsorted(to[by_end], counts, s) for s in ("left", "right")]
    name = node * 8 + kind

    def known(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(nodes, at), n - 1)
        return i, nodes[i] == at

    column = lambda rows, c: np.array([r[c] for r in rows])
    jobs: dict[tuple, list] = {}
    for row in searches.to_pylist():
        entries = [x for x in row["entries"] if np.isfinite(x["m"] + x["s"])]
        exits = sorted((x for x in row["exits"] if np.isfinite(x["x_m"] + x["x_s"])), key=lambda x: x["destination_id"])
        if not entries or not exits:
            continue
        seeds, ok = known(column(entries, "node"))
        entry = seeds[ok], column(entries, "m")[ok], column(entries, "s")[ok]
        ends, ok = known(column(exits, "node"))
        leave = [ends[ok], *(column(exits, c)[ok] for c in ("destination_id", "x_m", "x_s"))]
        if len(entry[0]) and len(ends[ok]):
            for m in row["modes"]:
                jobs.setdefault((m["k_toll"], m["k_m"], m["k_s"]), []).append((row["origin_id"], row["vehicle_class"], m, entry, leave))
    found = []
    for (k_toll, k_m, k_s), members in jobs.items():
        price = lambda t, m, s: k_toll * t + k_m * m + k_s * s
        weight = price(toll, e_m, e_s)
        left = max(m["bound"] if m["bound"] is not None else np.inf for _, _, m, _, _ in members)
        usable = by_start[weight[by_start] <= left + slack(left)]
        kept = np.append(0, np.cumsum(weight[by_start] <= left + slack(left)))
        graph = kept[out[0]], kept[out[1]], to[usable], weight[usable]
        for origin, kind_of, m, (seeds, entry_m, entry_s), (ends, places, x_m, x_s) in members:
            legs, firsts = price(0.0, x_m, x_s), np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            cost, own = least_costs(n, seeds, price(0.0, entry_m, entry_s), graph, ends, legs, firsts, m["bound"] if m["bound"] is not None else np.inf)
            total = cost[ends] + legs
            for i, j in zip(firsts, [*firsts[1:], len(ends)]):
                at = min(range(i, j), key=lambda x: (total[x], nodes[ends[x]], x_m[x], x_s[x]))
                if np.isfinite(total[at]):
                    way = way_back(int(ends[at]), cost, own, (*into, by_end, start, weight, name))
                    steps = [{"node": int(nodes[v]), "kind": None if e < 0 else int(kind[e]), "toll": None if e < 0 else float(toll[e]), "e_m": None if e < 0 else float(e_m[e]), "e_s": None if e < 0 else float(e_s[e])} for v, e in way]
                    found.append({"origin_id": origin, "vehicle_class": kind_of, "mode": m["mode"], "destination_id": int(places[at]), "cost": float(total[at]), "last_m": float(x_m[at]), "last_s": float(x_s[at]), "path": steps})
    return pa.Table.from_pylist(found, schema=FOUND)
