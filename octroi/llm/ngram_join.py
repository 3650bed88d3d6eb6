"""Documents joined by the Jaccard similarity of their word n-grams, with prefix filters under several orders.

A document's set is its distinct four-word shingles (the whole word sequence if it has fewer words; words are
runs of bytes that are not ASCII white space, A-Z lower-cased). If two sets are similar enough, then under any
one order of all tokens their prefixes, the first n - ceil(LEAST n / 100) + 1 tokens of n, have a token in
common. Each order gives such a filter, and what is verified has passed all of them. There are three orders,
rare tokens first in each: by the number of documents, by its binary magnitude, and by every other binary
magnitude, ties in a different pseudo-random order each time. So a token that two documents share by chance
at the end of one prefix is unlikely to be backed by the other two.

1. Numbers of documents. A task cuts its texts into steps of bounded size, and sends each distinct token of a
   step once, with how many of the step's documents hold it, to the token's bucket. The bucket adds up and
   answers the steps, for the tokens of two documents or more only. Tokens travel as 40 bits; two that agree in
   them count as one, which makes prefixes overlap more, never less.
2. Prefixes. A step that has its answers takes each document's prefixes. Tokens of a single document come
   first in all orders, so a document that has enough of them meets nobody and has no prefix to store.
3. Candidates. Documents of equal sets are one class, which goes on as its least doc_id. In the first
   order, the classes that hold a prefix token form its bucket. In each of the first rounds a bucket's members of
   other components meet one of its members, another one in each bucket. Buckets that still hold several components
   are then compared in tiles: blocks of `TILE` members against blocks, each pair of blocks in a task of its own,
   by products of the 0/1 matrices of their other two prefixes; only pairs of different components that pass leave
   a tile.
4. Pairs that pass all orders, tested on the whole prefixes, are verified on full sets of 64-bit hashes. A tile
   looks at the parities of the sets first: each bit in which they differ stands for at least one token that only
   one of the two sets has, so a pair with too many is not similar enough.

Nothing is capped: a pair that isn't compared is known to be in one component, to be of too different sizes, or
to fail an order.

Cases: without words or text the set is empty and linked with nothing. Rows that repeat a doc_id are one node
with several sets. A row without doc_id is linked with nothing and has no component. Extra columns are ignored.
An empty table gives no rows. The scan of `docs` must give a task the same rows again if it is run again, as files do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import by_key, give_back, mix, ranges, release, small_batches, steps
from octroi.llm.graph import components
from octroi.llm.odd_sketch import shingles
from octroi.session import written

#: Words of a shingle; the least similarity in hundredths.
SHINGLE, LEAST = 4, 85
#: Text bytes of a step, and text bytes whose tokens make a bucket.
STEP, BUCKET = 2 << 20, 4 << 20
#: Members of a block, and tokens of a prefix that travel to a tile; longer prefixes are told apart afterwards.
TILE, CARRIED = 128, 64
#: Seeds of the rounds in which a bucket meets one of its members; bits of a set's parities.
ROUNDS, PARITY_BITS = (1, 2), 2048
#: Right shift of a binary magnitude for each order (None: the number itself), and its tie-breaking seed.
ORDERS = ((None, 0x9E3779B97F4A7C15), (0, 0xC2B2AE3D27D4EB4F), (1, 0x165667B19E3779F9))
#: How a step's own record begins: its documents, and its tokens of several documents.
RECORD = "<QQ"


def planes(token: np.ndarray, ref: np.ndarray, count: np.ndarray) -> bytes:
    """Thirteen bytes an entry, high parts apart from low ones, as they are mostly zero and pack well."""
    count = np.minimum(count, 0xFFFFFFFF)
    low, part = token & np.uint64(0xFFFFFFFF), lambda v, k: ((v >> k) & 0xFFFF).astype("<u2")
    return b"".join(x.tobytes() for x in (low.astype("<u4"), (token >> np.uint64(32)).astype("u1"), part(ref, 0), part(ref, 16), part(count, 0), part(count, 16)))


def entries(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, at, out = len(body) // 13, 0, []
    for kind in ("<u4", "u1", "<u2", "<u2", "<u2", "<u2"):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * out[-1].itemsize
    wide = lambda low, high: low.astype(np.int64) | (high.astype(np.int64) << 16)
    return out[0].astype(np.uint64) | (out[1].astype(np.uint64) << np.uint64(32)), wide(out[2], out[3]), wide(out[4], out[5])


def prefix_size(n: np.ndarray, least: int = LEAST) -> np.ndarray:
    return np.where(n > 0, n - -(-least * n // 100) + 1, 0)


def ask(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """to, step, body: each step's distinct tokens for their bucket, and with a negative `to` the step's own record."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for rows, data, at in steps(batches, size=STEP):
            sets = shingles(data, at, size)
            n = np.array([len(s) for s in sets], np.int64)
            low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            high = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
            has = rows.column(0).is_valid().to_numpy(False)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint32), np.where(has, n, 0))
            token = np.concatenate([s if h else s[:0] for s, h in zip(sets, has, strict=True)]) >> np.uint64(24)
            del sets
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
            count = np.diff(np.append(first, len(token)))
            several = count > 1
            ref = doc[first].astype(np.int64)
            ref[several] = len(n) + np.arange(int(several.sum()))
            shared = doc[np.repeat(several, count)]
            token = token[first]
            step = part << 32 | number
            number += 1
            record = [struct.pack(RECORD, len(n), int(several.sum())), has.astype("u1").tobytes(), rows.column(0).fill_null(0).to_numpy().astype("<i8").tobytes(), n.astype("<i8").tobytes(), low.tobytes(), high.tobytes(), count[several].astype("<u4").tobytes(), shared.astype("<u4").tobytes()]
            to, body = [-1 - step], [b"".join(record)]
            bucket = ((token >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                to.append(int(bucket[i]))
                body.append(planes(token[i:j], ref[i:j], count[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(len(to), step)), pa.array(body, pa.binary())], names=["to", "step", "body"])

    return docs.mapInArrow(cut, "to long, step long, body binary")


def answer(asked: DataFrame) -> DataFrame:
    """step, own, body: for each step that asked, its tokens of two documents or more with their numbers; own records pass."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            step, bodies = t.column("step").to_numpy(), t.column("body")
            if t.column("to")[0].as_py() < 0:
                yield from t.select(["step"]).append_column("own", pa.array(np.ones(len(step), bool))).append_column("body", bodies).to_batches()
                continue
            parts = [entries(b.as_py()) for b in bodies]
            token, ref, count = (np.concatenate(p) for p in zip(*parts, strict=True))
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            del parts
            order = np.argsort(token, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
            total = np.zeros(len(token), np.int64)
            total[order] = np.repeat(np.add.reduceat(count[order], first), np.diff(np.append(first, len(order))))
            keep = np.flatnonzero(total > 1)
            edge = np.searchsorted(owner[keep], np.arange(len(step) + 1))
            body = [planes(token[keep[i:j]], ref[keep[i:j]], total[keep[i:j]]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(np.zeros(len(step), bool)), pa.array(body, pa.binary())], names=["step", "own", "body"])
            give_back()

    return asked.repartition("to").sortWithinPartitions("to").mapInArrow(add, "step long, own boolean, body binary")


PREFIXED = "doc_id long, n_shingles long, low long, high long, first array<long>, second array<long>, third array<long>"


def ranked_within(doc: np.ndarray, token: np.ndarray, count: np.ndarray, shift: int | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries by document and order, and each one's place within its document."""
    grade = count if shift is None else np.frexp(count.astype(float))[1].astype(np.int64) >> shift
    order = np.lexsort((mix(token ^ np.uint64(seed)), grade, doc))
    sorted_doc = doc[order]
    return order, np.arange(len(doc)) - np.searchsorted(sorted_doc, sorted_doc)


def prefixes(answered: DataFrame, least: int) -> DataFrame:
    """A row for each document: its set's size and print, and its prefixes without the tokens that it alone has.

    The prefixes are null if one of them is empty, as then no other document can be similar enough.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            own = t.column("own").to_numpy()
            bodies = t.column("body")
            record = bodies[int(own.argmax())].as_py()
            docs, several = struct.unpack_from(RECORD, record)
            at, parts = struct.calcsize(RECORD), []
            for kind, n in (("u1", docs), ("<i8", docs), ("<i8", docs), ("<i8", docs), ("<i8", docs), ("<u4", several)):
                parts.append(np.frombuffer(record, kind, n, at))
                at += parts[-1].nbytes
            has, ids, size, low, high, held = parts
            shared = np.frombuffer(record, "<u4", -1, at).astype(np.int64)
            asked = [entries(bodies[int(k)].as_py()) for k in np.flatnonzero(~own)] or [entries(b"")]
            token, ref, count = (np.concatenate(p) for p in zip(*asked, strict=True))
            del asked
            # a token of several of the step's documents stands for each of them
            begin = np.concatenate([[0], np.cumsum(held.astype(np.int64))])
            lone = ref < docs
            which = ref[~lone] - docs
            times = held[which].astype(np.int64)
            doc = np.concatenate([ref[lone], shared[np.repeat(begin[which], times) + ranges(times)]])
            token = np.concatenate([token[lone], np.repeat(token[~lone], times)])
            count = np.concatenate([count[lone], np.repeat(count[~lone], times)])
            ahead = size - np.bincount(doc, minlength=docs)  # tokens that no other document has
            room = prefix_size(size, least) - ahead
            open_ = room[doc] > 0
            doc, token, count = doc[open_], token[open_], count[open_]
            lists, filled = [], room > 0
            for shift, seed in ORDERS:
                order, place = ranked_within(doc, token, count, shift, seed)
                order = order[place < room[doc[order]]]
                lists.append((doc[order], token[order]))
                filled = filled & (np.bincount(doc[order], minlength=docs) > 0)
            out = [pa.array(ids, mask=has == 0), pa.array(size), pa.array(low), pa.array(high)]
            for of, values in lists:
                keep = filled[of]
                n = np.bincount(of[keep], minlength=docs)
                bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[keep].view(np.int64)), mask=pa.array(~filled)))
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in PREFIXED.split(", ")])
            give_back()

    return answered.repartition("step").sortWithinPartitions("step").mapInArrow(take, PREFIXED)


def parities(values: np.ndarray) -> bytes:
    """For each of PARITY_BITS places whether an odd number of the values falls on it."""
    place = mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(PARITY_BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1).tobytes()


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, shingles, parity of each row of `docs`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            sets = shingles(data, at, size)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat)), pa.array([parities(s) for s in sets], pa.binary())], names=["doc_id", "n", "shingles", "parity"])

    return docs.mapInArrow(pack, "doc_id long, n long, shingles array<long>, parity binary")


def similar_size(x: Column, y: Column, least: int) -> Column:
    return 100 * F.least(x, y) >= least * F.greatest(x, y)


def renamed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns))


def met_in_all_orders(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose prefixes share a token under each of the other orders."""
    rows = nodes.select("doc_id", "second", "third")
    joined = pairs.join(renamed(rows, "a"), F.col("a") == F.col("doc_id_a")).join(renamed(rows, "b"), F.col("b") == F.col("doc_id_b"))
    return joined.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    sets = sets.drop("parity")
    joined = pairs.join(renamed(sets, "a"), F.col("a") == F.col("doc_id_a")).join(renamed(sets, "b"), F.col("b") == F.col("doc_id_b"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return joined.where(100 * both >= least * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct()


def head_pairs(members: DataFrame, seed: int, least: int) -> DataFrame:
    """a, b: each bucket's members of other components beside one of its members; members: token, doc_id, n, component."""
    lead = F.struct(F.xxhash64("token", "doc_id", F.lit(seed)).alias("h"), F.col("doc_id").alias("head"), F.col("n").alias("head_n"), F.col("component").alias("head_component"))
    heads = members.groupBy("token").agg(F.min(lead).alias("m")).select("token", "m.*")
    met = members.join(heads, "token").where("component <> head_component").where(similar_size(F.col("n"), F.col("head_n"), least))
    return met.select(F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b")).distinct()


def pairs_in_tiles(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: int, tile: int) -> DataFrame:
    """Pairs of different components in a bucket that pass the other orders as far as their prefixes were carried.

    members: token, doc_id, n, component. The two members of a bucket of two have met.
    """
    open_ = members.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.count("*").alias("held")).where("l <> h and held > 2")
    open_ = open_.select("token", F.ceil(F.col("held") / tile).cast("int").alias("blocks"))
    carried = [F.when(F.size(c) <= CARRIED, F.col(c)).alias(c) for c in ("second", "third")]
    rows = members.join(open_, "token").join(nodes.select("doc_id", "n", *carried), ["doc_id", "n"]).join(sets.select("doc_id", "n", "parity"), ["doc_id", "n"])
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.xxhash64("token", i, j).alias("tile"), "token", i.alias("i"), j.alias("j"), "block", "doc_id", "n", "component", "second", "third", "parity")

    def overlap(column: pa.ChunkedArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x by y: whether two members' carried prefixes share a token; true for those too long to be carried."""
        lists = column.combine_chunks()
        missing = lists.is_null().to_numpy(False)
        n = np.diff(lists.offsets.to_numpy())
        values, inverse = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        dense = np.zeros((len(lists), len(values)), np.float32)
        dense[np.repeat(np.arange(len(lists)), np.where(missing, 0, n)), inverse] = 1
        return (dense[x] @ dense[y].T > 0) | missing[x][:, None] | missing[y]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            where = np.stack([t.column(c).to_numpy() for c in ("token", "i", "j")])
            for one in np.unique(where, axis=1).T:  # one, unless two tiles' hashes are equal
                u = t.filter(pa.array((where == one[:, None]).all(0)))
                doc, n, component, block = (u.column(c).to_numpy() for c in ("doc_id", "n", "component", "block"))
                x, y = np.flatnonzero(block == one[1]), np.flatnonzero(block == one[2])
                fit = component[x][:, None] != component[y]
                fit &= 100 * np.minimum(n[x][:, None], n[y]) >= least * np.maximum(n[x][:, None], n[y])
                if not fit.any():
                    continue
                fit &= overlap(u.column("second"), x, y) & overlap(u.column("third"), x, y)
                p, q = np.nonzero(fit)
                p, q = x[p], y[q]
                parity = np.frombuffer(b"".join(u.column("parity").to_pylist()), np.uint64).reshape(len(doc), -1)
                apart = [np.bitwise_count(parity[p[i : i + 4096]] ^ parity[q[i : i + 4096]]).sum(1, dtype=np.int64) for i in range(0, len(p), 4096)]
                close = (100 + least) * np.concatenate([np.zeros(0, np.int64), *apart]) <= (100 - least) * (n[p] + n[q])
                p, q = doc[p[close]], doc[q[close]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "a long, b long").distinct()


def ngram_join(docs: DataFrame, size: int = SHINGLE, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    prefixed = written(prefixes(answer(ask(rows, size, int(volume // BUCKET) + 1)), least), "prefixes")
    release(spark)
    same = ["n_shingles", "low", "high"]
    linkable = prefixed.where("n_shingles > 0 and doc_id is not null")
    taken = F.first(F.struct("first", "second", "third"))
    classes = linkable.groupBy(*same).agg(F.min("doc_id").alias("node"), taken.alias("prefix"))
    classes = written(classes.select(*same, "node", "prefix.*"), "classes")
    of_class = classes.select(*same, "node")
    known = written(prefixed.select("doc_id", *same).join(of_class, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "nodes")
    nodes = classes.where("first is not null").select(F.col("node").alias("doc_id"), F.col("n_shingles").alias("n"), "first", "second", "third")
    posted = nodes.select(F.explode("first").alias("token"), "doc_id", "n").distinct()
    shared = posted.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token")
    members = written(posted.join(shared, "token").withColumn("component", F.col("doc_id")), "members")
    release(spark)
    wanted = members.select("doc_id").distinct()
    sets = written(full_sets(rows.join(wanted, "doc_id", "left_semi"), size).dropDuplicates(), "sets")

    # rows of one doc_id with several sets tie the classes of these sets together
    several = known.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("h")).where("b <> h").select("doc_id", "b")
    edges = written(known.join(several, "doc_id").select(F.col("node").alias("a"), "b"), "edges")
    for k in range(len(ROUNDS) + 1):
        pairs = head_pairs(members, ROUNDS[k], least) if k < len(ROUNDS) else pairs_in_tiles(members, nodes, sets, least, tile)
        edges = edges.union(written(verified(met_in_all_orders(pairs, nodes), sets, least), "links"))
        if k < len(ROUNDS):
            labels = components(edges).withColumnRenamed("node", "doc_id")
            labelled = members.drop("component").join(labels, "doc_id", "left")
            members = written(labelled.withColumn("component", F.coalesce("component", "doc_id")), "members")
            release(spark)
    labels = components(edges)
    return known.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def checking_sql(size: int = SHINGLE, least: int = LEAST) -> str:
    """The same rows for DuckDB, from all pairs that share a shingle."""
    return f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i : i + least({size}, len(w)) - 1]) AS s FROM w, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS r(i) WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= {least} * (x.n + y.n - m)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    c AS (SELECT a AS doc, b AS reached FROM e UNION SELECT c.doc, e.b FROM c JOIN e ON e.a = c.reached)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(reached) FROM c WHERE c.doc = doc_id), doc_id)) AS component_id
    FROM documents LEFT JOIN n USING (doc_id)
    """
