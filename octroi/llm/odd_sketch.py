"""Near-duplicate documents: MinHash bands for candidates, odd sketches to judge them, full sets to confirm.

A document's set is its distinct five-word shingles (the whole word sequence if it has fewer words; words
are runs of bytes that are not ASCII white space, A-Z lower-cased). Documents of equal sets form a class and
go on as one. `SAMPLES` MinHash values are drawn of each class; three at a time make a band key, and all are
folded into an odd sketch, a bitmap that holds the parity of the values hashed to each bit. The XOR of two
sketches has as many bits as the samples differ, in expectation, so its population count estimates a
similarity, most precisely where it is high.

Links are found in two ways, both confirmed on full sets. First the members of a band bucket meet the
members of the bucket that share most buckets with others: at most `PIVOTS` a bucket, so the pairs grow with
the members. Then, in the buckets that still hold more than one component, the sketches of members of
different components are compared within the bucket's task, in numpy; only the pairs that pass leave it,
each in the first band that it shares. Pairs of one component aren't looked at again. There is no cap: a
pair is left out only if it shares no band (at similarity 0.75: 2e-8) or if its sketches differ in more bits
than `PLAUSIBLE` allows: at 0.75 they differ in 87 bits with a deviation of 11, and 138 are allowed, so about
one pair in a million at that similarity is lost, and fewer above it.

Cases: without words or text the set is empty, linked with nothing. Rows that repeat a doc_id are one
node with several sets. A row without doc_id is linked with nothing, keeps a null component and stays.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octroi.llm.common import LOWER, binary_rows, mix, powers, prefix_hash, ranges, small_batches, span_hash, steps, word_spans
from octroi.llm.graph import components
from octroi.session import written

#: Words of a shingle; the least similarity in hundredths.
SHINGLE, LEAST = 5, 75
SAMPLES, BANDS, ROWS, SKETCH_BITS = 192, 32, 3, 1024
#: Members of a bucket that all others meet in each of the first rounds.
PIVOTS = (1, 2), (3, 6)
#: Least similarity by sketches that is confirmed on full sets.
PLAUSIBLE = 0.58

_draw = np.random.default_rng(20_011)
_FLIP = _draw.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_TIMES = _draw.integers(0, 2**62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_BASE = 0xA24BAED4963EE407 | 1
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = LOWER[data]
    start, end, row = word_spans(~_SPACE[low], at)
    word = span_hash(prefix_hash(low), start, end)
    first = np.searchsorted(row, np.arange(len(at)))
    prefix = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * powers(_WORD_BASE, len(word))[:-1], out=prefix[1:])
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    a = np.repeat(first[:-1], count) + ranges(count)
    b = np.minimum(a + size, np.repeat(first[1:], count))
    each = mix((prefix[b] - prefix[a]) * powers(_WORD_INVERSE, len(word))[a] + (b - a).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    return [np.unique(each[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def minhash(values: np.ndarray) -> np.ndarray:
    """SAMPLES values, each the least of the set under another mapping; long sets in pieces."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(out, ((values[None, i : i + 1024] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Rows of BANDS keys; a key also holds its band's number."""
    part = samples[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ part[:, :, k])
    return key.view(np.int64)


def sketch(samples: np.ndarray) -> np.ndarray:
    """Rows of SKETCH_BITS parities as 64-bit words."""
    place = mix(samples + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) % np.uint64(SKETCH_BITS)
    parity = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    for k in range(SAMPLES):
        parity[np.arange(len(samples)), place[:, k].astype(np.int64)] ^= 1
    return np.packbits(parity, axis=1).view(np.uint64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the population count of two sketches' XOR."""
    left = np.maximum(1 - 2 * differing / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(left)


#: The largest count of differing bits that still is plausible.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - np.exp((PLAUSIBLE - 1) * 4 * SAMPLES / SKETCH_BITS)))

SIGNED = "doc_id long, n_shingles long, low long, high long, bands array<long>, words array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Size, a 128-bit print of the set, band keys and sketch of each row of `docs` (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            sets = shingles(data, at)
            samples = np.stack([minhash(s) for s in sets])
            low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            high = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            keys, bits = band_keys(samples), sketch(samples)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), lists(keys), lists(bits)], names=["doc_id", "n_shingles", "low", "high", "bands", "words"])

    return _pick(docs).mapInArrow(sign, SIGNED)


def _pick(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, low, high, shingles: the sets themselves, as packed sorted hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            sets = shingles(data, at)
            flat = np.concatenate(sets)
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            low = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(low), binary_rows(flat, bounds)], names=["doc_id", "low", "shingles"])

    return _pick(docs).mapInArrow(pack, "doc_id long, low long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("p"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("q"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                u, v = (u, v) if len(u) <= len(v) else (v, u)
                both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                same.append(100 * both >= LEAST * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(judge, "a long, b long").distinct()


def similar_size(x, y):
    return 100 * F.least(x, y) >= LEAST * F.greatest(x, y)


def pivot_pairs(members: DataFrame, first: int, last: int) -> DataFrame:
    """Pairs of each bucket's members with its members of rank first … last, unless one component holds both."""
    bucket = Window.partitionBy("key")
    ranked = members.withColumn("rank", F.row_number().over(bucket.orderBy(F.desc("degree"), "doc_id", "n")))
    for k in range(first, last + 1):
        of_pivot = lambda c, k=k: F.max(F.when(F.col("rank") == k, F.col(c))).over(bucket)
        ranked = ranked.withColumns({f"pivot{k}": of_pivot("doc_id"), f"n{k}": of_pivot("n"), f"component{k}": of_pivot("component")})
    pairs = F.array(
        *(
            F.when((F.col("rank") > k) & (F.col("component") != F.col(f"component{k}")) & similar_size(F.col("n"), F.col(f"n{k}")), F.struct(F.least("doc_id", f"pivot{k}").alias("a"), F.greatest("doc_id", f"pivot{k}").alias("b")))
            for k in range(first, last + 1)
        )
    )
    return ranked.select(F.explode(F.array_compact(pairs)).alias("pair")).select("pair.*").distinct()


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches differ in few enough bits, counted on the sketches' 64-bit words."""
    p = classes.select(F.col("doc_id").alias("a"), F.col("words").alias("p"))
    q = classes.select(F.col("doc_id").alias("b"), F.col("words").alias("q"))
    differing = F.aggregate(F.zip_with("p", "q", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    return pairs.join(p, "a").join(q, "b").where(differing <= MOST_BITS).select("a", "b").distinct()


def bucket_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Plausible pairs of different components within the buckets that hold several, each pair once."""
    open_ = members.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("key")
    rows = members.join(open_, "key").join(classes.select("doc_id", F.col("n_shingles").alias("n"), "bands", "words"), ["doc_id", "n"])

    def compare(key: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        order = np.argsort(t.column("component").to_numpy(), kind="stable")
        doc, component, n = (t.column(c).to_numpy()[order] for c in ("doc_id", "component", "n"))
        bands, bits = (t.column(c).combine_chunks().flatten().to_numpy().reshape(len(doc), -1)[order] for c in ("bands", "words"))
        after = np.searchsorted(component, component, "right")  # rows before it are of the same component or came earlier
        for i in range(len(doc)):
            for j in range(int(after[i]), len(doc), 16384):
                s = slice(j, min(j + 16384, len(doc)))
                at = np.flatnonzero(100 * np.minimum(n[s], n[i]) >= LEAST * np.maximum(n[s], n[i])) + j
                at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64) <= MOST_BITS]
                if len(at):
                    at = at[bands[i][(bands[at] == bands[i]).argmax(1)] == key]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[at])), pa.array(np.maximum(doc[i], doc[at]))], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and keys[i] != last:
                    yield from compare(last, held)
                    held = []
                last = keys[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from compare(last, held)

    picked = rows.select("key", "doc_id", "component", "n", "bands", "words").repartition("key").sortWithinPartitions("key")
    return picked.mapInArrow(walk, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs` (doc_id, text)."""
    same = ["n_shingles", "low", "high"]
    signed = written(signatures(docs), "signatures")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    grouped = linkable.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("words").alias("words"))
    classes = written(grouped, "classes")
    of_class = classes.select(*same, F.col("doc_id").alias("first_id"))
    rows = written(signed.select("doc_id", *same).join(of_class, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first_id")).alias("first_id")), "rows")

    banded = classes.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = banded.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    shared = written(shared, "buckets")
    degree = shared.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    members = written(shared.join(degree, "doc_id").withColumn("component", F.col("doc_id")), "members")
    wanted = docs.select("doc_id", "text").join(degree.select("doc_id"), "doc_id", "left_semi")
    sets = written(full_sets(wanted).dropDuplicates(["doc_id", "low"]), "sets")

    several = rows.where("first_id is not null").groupBy("doc_id").agg(F.min("first_id").alias("b"), F.max("first_id").alias("h")).where("b <> h").select("doc_id", "b")
    edges = written(rows.join(several, "doc_id").select(F.col("first_id").alias("a"), "b"), "edges")
    for first, last in PIVOTS:
        found = plausible(pivot_pairs(members, first, last), classes)
        edges = edges.union(written(confirmed(found, sets), "links"))
        labels = components(edges)
        members = written(members.drop("component").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "members")
    edges = edges.union(written(confirmed(bucket_pairs(members, classes), sets), "links"))
    labels = components(edges).withColumnRenamed("node", "first_id")
    component = F.coalesce("component", "first_id", "doc_id")
    return rows.join(labels, "first_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
