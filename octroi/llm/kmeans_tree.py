"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Vectors get one more component that gives all the same length, so that the largest inner product is the
least distance. The tree is fitted on the driver from a bounded sample (`SAMPLE` vectors); every vector is
then indexed: it descends to the nearest child at each level until a leaf. A query visits leaves from a
priority queue that always opens the node whose centre is nearest. How many leaves are visited is calibrated:
for `CALIBRATION` queries the true neighbours are found by brute force over all vectors, and the visits are
widened until the share of them in visited leaves reaches `RECALL`.

Queries and vectors meet per leaf in tiles of at most about `TILE` by `TILE`, so neither a crowded leaf nor a
leaf that very many queries visit is gathered in one task. The first leaves give each query a score that its
k-th neighbour reaches at least, and the other leaves return only what comes up to it. Equal vectors are indexed once, with the least
ids that any answer can need.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
those whose length isn't the commonest, nor rows without vec_id. Of rows that share a vec_id the least
vector counts. Ties go to the smaller vec_id. With fewer candidates than asked for, all are returned. An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octroi.llm.common import binary_rows
from octroi.session import written

#: Vectors that the tree is fitted on; children of a node; vectors of a leaf, in the whole table and at least in the sample.
SAMPLE, BRANCH, LEAF, LEAF_SAMPLE = 40_000, 8, 800, 12
CALIBRATION, RECALL, TILE = 200, 0.95, 2_000
#: Leaves that a query visits first; what it finds there is the least score that the others must reach.
FIRST = 2


class Tree:
    """children[i]: first child of node i or -1; centre[i]; leaf[i]: its number or -1."""

    def __init__(self, x: np.ndarray, leaf_size: float, seed: int = 5):
        r = np.random.default_rng(seed)
        self.children, self.count, self.leaf, centres = [-1], [0], [-1], [x.mean(0) if len(x) else np.zeros(x.shape[1])]
        self.leaves, todo = 0, [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self.split(x[rows], min(BRANCH, int(np.ceil(len(rows) / leaf_size))), r) if len(rows) > max(leaf_size, BRANCH) else None
            if parts is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            centre, of = parts
            self.children[node], self.count[node] = len(self.children), len(centre)
            for k, c in enumerate(centre):
                todo.append((len(self.children), rows[of == k]))
                self.children.append(-1), self.count.append(0), self.leaf.append(-1), centres.append(c)
        self.centre = np.array(centres)

    @staticmethod
    def split(x: np.ndarray, k: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
        centre = x[r.choice(len(x), k, replace=False)]
        for _ in range(8):
            of = nearest(x, centre)
            used = np.unique(of)
            if len(used) < 2:
                return None
            centre = np.stack([x[of == k].mean(0) for k in used])
        return centre, nearest(x, centre)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            first = self.children[node]
            of = nearest(x[rows], self.centre[first : first + self.count[node]])
            todo += [(first + k, rows[of == k]) for k in np.unique(of)]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, in the order in which the priority queue opens them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            first = self.children[node]
            far = ((self.centre[first : first + self.count[node]] - q) ** 2).sum(1)
            for k, d in enumerate(far.tolist()):
                heapq.heappush(queue, (d, first + k))


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One component more, so that all rows are `longest` long."""
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))])


def matrix(column, width: int) -> np.ndarray:
    """Packed float32 rows of a pandas or Arrow column, in double precision."""
    data = b"".join(column)
    return np.frombuffer(data, np.float32).reshape(-1, width).astype(float) if data else np.zeros((0, width))


def best(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by descending score, then ascending first id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((first[at], -score[at]))][:k]


def sound_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (packed) of the rows that take part, and their vectors' length."""
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0)
    sound = sound.where(F.col("vec_id").isNotNull() & finite).groupBy("vec_id").agg(F.min("e").alias("e"))
    sound = written(sound, "vectors")
    sizes = sound.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    width = sizes[0].d if sizes else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy().astype(np.float32) + np.float32(0)  # -0 is 0
            yield pa.RecordBatch.from_arrays([b.column(0), binary_rows(flat, np.arange(b.num_rows + 1) * width)], names=["vec_id", "v"])

    return sound.where(F.size("e") == width).mapInArrow(pack, "vec_id long, v binary"), width


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v, first, ids: the k + 1 least ids of each distinct vector; the ranking is cut before its shuffle too."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    grouped = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 each
    return grouped.select("v", F.col("ids")[0].alias("first"), "ids")


def brute_force(queries: DataFrame, vectors: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, v, ids, leaf, score: the k best distinct vectors for a bounded set of queries, over all vectors."""
    rows = queries.collect()
    names, q = np.array([r.query_id for r in rows]), matrix([bytes(r.q) for r in rows], width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = q @ matrix(b.column(0).to_pylist(), width).T
            first = b.column(1).to_numpy()
            for i, name in enumerate(names):
                at = best(score[i], first, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at)), pa.array(score[i][at])], names=["query_id", "first", "ids", "leaf", "score"])

    found = vectors.select("v", "first", "ids", "leaf").mapInArrow(scan, "query_id long, first long, ids array<long>, leaf int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def true_neighbours(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (and leaf if there) from distinct vectors: ids are spread, own ids left out."""
    spread = found.withColumn("vec_id", F.explode("ids")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def visits_for(tree: Tree, truth: list, queries: dict[int, np.ndarray], recall: float) -> int:
    """Leaves to visit so that the calibration queries find `recall` of their true neighbours."""
    place = {q: {leaf: i for i, leaf in enumerate(tree.best_first(v))} for q, v in queries.items()}
    needed = np.array([place[r.query_id][r.leaf] + 1 for r in truth])
    visits = 1
    while len(needed) and (needed <= visits).mean() < recall:
        visits += max(1, visits // 8)
    return min(visits, tree.leaves)


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id `every` divides, the k nearest found among the others."""
    spark = vectors.sparkSession
    rows, width = sound_vectors(vectors)
    base = written(distinct_vectors(rows, k), "distinct-vectors")
    asked = written(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((matrix(b.column(0).to_pylist(), width) ** 2).sum(1).max(initial=0)))])], names=["n"])

    total, longest = base.count(), base.select("v").mapInArrow(norms, "n double").agg(F.max("n")).first()[0] or 1.0
    share = min(1.0, SAMPLE / max(1, total))
    sample = base.where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").collect()  # about SAMPLE
    tree = Tree(lifted(matrix(sorted(bytes(r.v) for r in sample), width), longest), max(LEAF_SAMPLE, LEAF * share))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.descend(lifted(matrix(b.column(0).to_pylist(), width), longest))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["v", "first", "ids", "leaf"])

    indexed = written(base.mapInArrow(assign, "v binary, first long, ids array<long>, leaf int"), "indexed")
    part = min(1.0, CALIBRATION / max(1, asked.count()))
    few = asked.where(F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(1_000_000)) < int(part * 1_000_000))
    truth = true_neighbours(brute_force(few, indexed, width, k + 1), k).select("query_id", "leaf").collect()
    visits = visits_for(tree, truth, {r.query_id: np.r_[matrix([bytes(r.q)], width)[0], 0.0] for r in few.collect()}, recall)

    held = {r.leaf: (r.rows, r.ids) for r in indexed.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("ids")).collect()}  # a row for each leaf

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, leaf, turn = [], [], []
            for i, q in enumerate(matrix(b.column(1).to_pylist(), width)):
                seen = 0
                for n, at in enumerate(tree.best_first(np.r_[q, 0.0])):
                    if n >= visits and seen > k:
                        break
                    seen += held.get(at, (0, 0))[1]
                    row.append(i), leaf.append(at), turn.append(n)
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(leaf, pa.int32()), pa.array(turn, pa.int32())], names=["query_id", "q", "leaf", "turn"])

    routed = written(asked.mapInArrow(route, "query_id long, q binary, leaf int, turn int"), "routed")
    visitors = {r.leaf: r.n for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    cuts = [(leaf, -(-rows // TILE), -(-visitors.get(leaf, 1) // TILE)) for leaf, (rows, _) in held.items()]
    tiles = F.broadcast(spark.createDataFrame(cuts, "leaf int, tiles int, deals int"))  # a row for each leaf, at most SAMPLE / LEAF_SAMPLE
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, salt, n: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
    left = indexed.join(tiles, "leaf").select("leaf", place("v", 3, "tiles").alias("tile"), numbers("deals").alias("deal"), "v", "first", "ids")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        scores = matrix(b["q"], width) @ matrix(a["v"], width).T
        first, ids = a["first"].to_numpy(), a["ids"].to_numpy()
        at = [best(s, first, k + 1) for s in scores]
        at = [x[s[x] >= f] for x, s, f in zip(at, scores, b["floor"].to_numpy(), strict=True)]
        return pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), [len(x) for x in at]), "ids": ids[np.concatenate(at)], "score": np.concatenate([s[x] for s, x in zip(scores, at, strict=True)])})

    def met(visits: DataFrame) -> DataFrame:
        """The best distinct vectors that each visit finds: query_id, ids, score."""
        right = visits.join(tiles, "leaf").select("leaf", numbers("tiles").alias("tile"), place("query_id", 4, "deals").alias("deal"), "query_id", "q", "floor")
        by = ["leaf", "tile", "deal"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(score, "query_id long, ids array<long>, score double")

    lowest = F.lit(float("-inf"))
    early = written(met(routed.where(F.col("turn") < FIRST).withColumn("floor", lowest)), "first-finds")
    floors = true_neighbours(early, k).where(F.col("rank") == k).select("query_id", (F.col("score") - F.abs("score") * 1e-9).alias("found"))
    rest = routed.where(F.col("turn") >= FIRST).join(floors, "query_id", "left").withColumn("floor", F.coalesce("found", lowest))
    return true_neighbours(early.union(met(rest)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
