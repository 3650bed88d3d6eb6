"""A round of a search over many weightings, block by block: whole rows of costs against a node's moves at once.

Spark deals the moves into blocks of bounded size, written once in buckets of the block, and sends every frontier
row to its block; a round exchanges frontier rows and the least candidates of each block, never the moves. In a
block the origins that share a class and a weighting share the weights of the moves, so a candidate is one addition
and one comparison of an array.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octroi.session import bucketed, written

#: Most moves that a block is meant to hold.
BLOCK_MOVES = 3_000_000
#: Most (search, node) rows that a block is meant to give back.
BLOCK_ROWS = 2_000_000


def _finite(values: np.ndarray) -> np.ndarray:
    """Floats, what is null or not a number as infinite."""
    return np.where(np.isnan(values), np.inf, values)


def least_candidates(visits: pa.Table, moves: pa.Table, keys: list[str], lanes: int, factors: list[str]) -> dict[str, np.ndarray]:
    """Least cost in each lane of every (keys, to_node) that the visits reach by the moves of one block.

    visits: keys, node, salt, c0 …, `factors` of each lane, b0 … where there are bounds. moves: node, salt and arrays
    of to_node, fan, e_m, e_s and tolls, the places of a row all different. The class, which tells the toll, is the second key.
    """
    each = lambda name: moves[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    start, leave = moves["node"].to_numpy(), moves["salt"].to_numpy()
    wide = 1 + max(int(leave.max()), int(visits["salt"].to_numpy().max()))
    key, here = start * wide + leave, visits["node"].to_numpy() * wide + visits["salt"].to_numpy()
    ends = np.append(0, np.cumsum(pc.list_value_length(moves["to_node"]).to_numpy()))
    targets, place = np.unique(each("to_node"), return_inverse=True)
    fan = np.zeros(len(targets), np.int32)
    fan[place] = each("fan")
    tolls = each("tolls").reshape(len(place), -1)
    metres, seconds = _finite(each("e_m")), _finite(each("e_s"))

    spots, spot = np.unique(here, return_inverse=True)
    found = np.minimum(np.searchsorted(spots, key), len(spots) - 1)
    runs = [(int(ends[i]), int(ends[i + 1]), int(found[i])) for i in np.flatnonzero(spots[found] == key)]
    names, first, search = np.unique(np.stack([visits[k].to_numpy() for k in keys], 1), axis=0, return_index=True, return_inverse=True)
    search = search.reshape(-1)
    costs = [_finite(visits[f"c{k}"].to_numpy()) for k in range(lanes)]
    out = np.full((len(names), len(targets), lanes), np.inf)
    weightings: dict[tuple, list[tuple[int, int]]] = {}
    for k in range(lanes):
        rows = np.stack([visits[f"{c}_{k}"].to_numpy()[first] for c in factors], 1)
        for n, row in enumerate(rows):
            weightings.setdefault((int(names[n][1]), *row), []).append((n, k))
    slot, limit = np.empty(len(names), np.int64), np.full((len(names), lanes), np.inf)
    if "b0" in visits.column_names:
        limit = np.stack([_finite(visits[f"b{k}"].to_numpy()[first]) for k in range(lanes)], 1)
    with np.errstate(invalid="ignore"):
        for (kind, k_toll, k_m, k_s), members in weightings.items():
            begin = np.full((len(spots), len(members)), np.inf)
            for k in {k for _, k in members}:
                slot[:] = -1
                for j, (n, lane) in enumerate(members):
                    if lane == k:
                        slot[n] = j
                mine = slot[search] >= 0
                begin[spot[mine], slot[search[mine]]] = costs[k][mine]
            live = np.isfinite(begin).any(1)
            if not live.any():
                continue
            # a move dearer than what all searches have left can lead nowhere that matters; a little more against rounding
            left = np.where(np.isfinite(begin), np.array([limit[m] for m in members]) - begin, -np.inf).max(1)
            left = left + np.abs(left) * 1e-9 + 1e-6
            toll = tolls[:, kind - 1]
            weight = k_toll * toll + k_m * metres + k_s * seconds
            weight[~(weight < np.inf) | ~(toll < np.inf)] = np.inf
            best = np.full((len(targets), len(members)), np.inf)
            for a, b, s in runs:
                if live[s]:
                    near = np.flatnonzero(weight[a:b] <= left[s]) + a
                    p = place[near]
                    best[p] = np.minimum(best[p], begin[s] + weight[near, None])
            for j, (n, k) in enumerate(members):
                out[n, :, k] = best[:, j]
    out[out > limit[:, None, :]] = np.inf
    n, t = np.nonzero(np.isfinite(out).any(2))
    table = {k: names[n, i] for i, k in enumerate(keys)} | {"node": targets[t]}
    return table | {f"n{k}": out[n, t, k] for k in range(lanes)} | {"fan": fan[t]}


def numbers_apart(spark: SparkSession, n: int) -> list[int]:
    """Numbers for n blocks that fall into different partitions, as long as there are any."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = Window.partitionBy("p").orderBy("id")
    some = spark.range(32 * (partitions + n)).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("p"))
    return [int(r["id"]) for r in some.withColumn("k", F.row_number().over(each)).orderBy("k", "p").limit(n).collect()]


class Blocks:
    """Deals moves and frontier rows into blocks: nodes in as many parts as their number asks for, searches in slices.

    keys: origin, class and bundle of a search; the searches of a class and bundle stay in one slice where they fit.
    """

    def __init__(self, keys: list[str], lanes: int, factors: list[str], n_moves: int, n_nodes: int, searches: DataFrame):
        origin, kind, bundle = keys
        spark = searches.sparkSession
        s = searches.agg(F.count(F.lit(1)).alias("n"), F.max(kind).alias("kinds"), (F.max(bundle) + 1).alias("bundles")).first()
        self.keys, self.lanes, self.factors = keys, lanes, factors
        self.parts = max(1, ceil(n_moves / BLOCK_MOVES))
        bundles, alike = s["bundles"] or 1, (s["kinds"] or 1) * (s["bundles"] or 1)
        wanted = max(ceil(2 * spark.sparkContext.defaultParallelism / self.parts), ceil((s["n"] or 0) * n_nodes / BLOCK_ROWS))
        spread = ceil(wanted / alike)
        self.slices = min(alike, wanted) * spread
        number = F.pmod((F.col(kind) - 1) * bundles + F.col(bundle), F.lit(min(alike, wanted))) * spread + F.pmod(F.col(origin), F.lit(spread))
        self._slice = number.cast("int")
        self._ids = F.array(*(F.lit(i) for i in numbers_apart(spark, self.parts * self.slices)))

    def _block(self, slice):
        """The block of a node's part and a slice."""
        return self._ids[F.pmod(F.xxhash64("node", "salt"), F.lit(self.parts)).cast("int") * self.slices + slice]

    def dealt(self, moves: DataFrame) -> DataFrame:
        """The moves once for each slice of searches, a row for each node and salt, in buckets of their block."""
        again = F.row_number().over(Window.partitionBy("node", "to_node").orderBy("kind"))
        row = F.collect_list(F.struct("to_node", "fan", "e_m", "e_s", "tolls")).alias("m")
        rows = moves.withColumn("nth", again).groupBy("node", "salt", "nth").agg(row)
        lists = [F.col(f"m.{c}").alias(c) for c in ("to_node", "fan", "e_m", "e_s")]
        slices = F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("slice")
        laid = written(rows.select("node", "salt", *lists, F.flatten("m.tolls").alias("tolls")), "move-rows").select("*", slices)
        return bucketed(laid.withColumn("block", self._block(F.col("slice"))).drop("slice"), "moves", ["block"])[0]

    def reached(self, visits: DataFrame, table: DataFrame) -> DataFrame:
        """Least candidates of the blocks: keys, node, n0 …, fan."""
        keys, lanes, factors = self.keys, self.lanes, self.factors
        kinds = {f.name: f.dataType.simpleString() for f in visits.schema.fields}
        names = [*keys, "node", *(f"n{k}" for k in range(lanes)), "fan"]
        schema = ", ".join(f"{c} {kinds.get(c, 'int' if c == 'fan' else 'double')}" for c in names)
        types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
        shape = pa.schema([(c, types[kinds.get(c, "int" if c == "fan" else "double")]) for c in names])

        def reach(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return shape.empty_table()
            found = least_candidates(left, right, keys, lanes, factors)
            return pa.table([pa.array(found[c]).cast(shape.field(c).type) for c in names], schema=shape)

        visits = visits.withColumn("block", self._block(self._slice))
        return visits.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(reach, schema)
