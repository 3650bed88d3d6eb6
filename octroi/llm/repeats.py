"""Removal of repeated byte strings: distributed prefix doubling over sampled positions.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else. The method ranks
positions by growing prefixes and drops a position once its rank is unique, as suffix-array prefix doubling
does, with names (hashes of equal strings) as ranks, which Spark groups and joins across the cluster.
Ranking every byte of the corpus at each doubling would move many times its size, so the rounds are:

1. Sampled positions ("anchors"): of the `FIRST`-byte strings in a window of LENGTH bytes the one with the
   least hash, the leftmost of equals. Equal windows have equal anchors at equal offsets, so the windows
   p … of one anchor form a run, and every window belongs to exactly one anchor. Spark groups anchors by
   the first rank, their FIRST-byte string; unique anchors are done: none of their windows repeats.
2. The remaining anchors get a second rank, the whole string that their run of windows spans. Anchors that
   share it are repeated in all their windows. If all anchors of a first rank share it, they are done.
3. The others are compared within their first rank at finer steps: windows in blocks of `STEP` offsets get
   the string that all of a block's windows have in common as rank, and blocks of equal rank are told
   apart by the STEP - 1 bytes on either side. Each anchor class sends one block there.

Work and shuffles are by anchors, about one in fifty bytes. A string held by very many documents makes large
groups; they are counted by aggregates with map-side combine and joined back (a join that the adaptive
planner splits), and step 3 collapses equal blocks before its shuffle, so only different surroundings of
one common string, at about a hundred bytes each, meet in a task.

A row is told apart by doc_id and 128 bits of its text, as many rows may share an id or have none.

Texts are bytes (UTF-8); matches never cross texts. Cases: null and empty texts keep no bytes; texts
shorter than LENGTH stay; rows that repeat a text remove it from all of them; a null doc_id is a document
like any other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import mix, prefix_hash, ranges, release, small_batches, span_hash, steps
from octroi.session import written

#: Bytes of a repeated string; bytes of the first rank; window offsets in a block of step 3.
LENGTH, FIRST, STEP = 200, 64, 16
SIDE = STEP - 1
PLACE = np.uint64((1 << 32) - 1)
_WEIGHTS = mix(np.arange(1, 2 * SIDE + 1, dtype=np.uint64) * np.uint64(0xDB4F0B9175AE2165))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by running minima of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first rank, second rank, first window, anchor - first window, last window - first window."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = prefix_hash(data)
    i = np.arange(len(data) - FIRST + 1)
    name = span_hash(prefix, i, i + FIRST)
    least = sliding_least((name & ~PLACE) | i.view(np.uint64), LENGTH - FIRST + 1)
    del i
    least &= PLACE
    anchor = least.view(np.int64)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[: len(anchor)]
    whole = np.arange(len(anchor)) + LENGTH <= at[row + 1]
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | ~whole[1:]
    lo, hi = np.flatnonzero(change[:-1] & whole), np.flatnonzero(change[1:] & whole)
    a = anchor[lo]
    span = mix(span_hash(prefix, lo, hi + LENGTH) ^ (a - lo).astype(np.uint64))
    return row[lo], name[a], span, lo, a - lo, hi - lo


def prints(text: Column) -> list[Column]:
    """128 bits that stand for a text: two 64-bit hashes, the second seeded with a prefix's."""
    return [F.xxhash64(text).alias("print"), F.xxhash64(F.lit("print"), text).alias("print2")]


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *prints(text), text.alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, print, print2, key, span, lo, shape of every anchor; shape packs the anchor's and the last window's distance from lo."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            row, key, span, lo, gap, width = anchors_of(data, at)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pick), rows.column(1).take(pick), rows.column(2).take(pick), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(span.astype(np.uint64).view(np.int64)), pa.array((lo - at[row]).astype(np.int32)), pa.array((gap * 256 + width).astype(np.int32))], names=["doc_id", "print", "print2", "key", "span", "lo", "shape"])

    long = docs.where(F.octet_length("text") >= LENGTH)
    return long.mapInArrow(find, "doc_id long, print long, print2 long, key long, span long, lo int, shape int")


BLOCKS = "kind int, doc_id long, print long, print2 long, core long, side binary, first int, last int, at int, known int"


def blocks(refs: DataFrame) -> DataFrame:
    """Blocks of windows of the anchors in `refs` (doc_id, print, print2, text, refs: lo, shape, known).

    kind 1 goes on to be compared; kind 0 are blocks found repeated already, as an equal one is in the same step.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            lists = rows.column(4)
            each = lists.flatten()
            row = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
            lo, shape, known = (each.field(k).to_numpy() for k in range(3))
            gap, width = shape >> 8, shape & 255
            a = at[row] + lo + gap
            b0, b1 = (gap - width) // STEP, gap // STEP
            n = b1 - b0 + 1
            r = np.repeat(np.arange(len(row)), n)
            b = b0[r] + ranges(n)
            j1, j2 = np.maximum(gap[r] - width[r] - STEP * b, 0), np.minimum(gap[r] - STEP * b, SIDE)
            c0 = a[r] - STEP * b
            c1 = c0 - SIDE + LENGTH
            core = mix(span_hash(prefix_hash(data), c0, c1) ^ mix(b.astype(np.uint64) + np.uint64(77)))
            k = np.arange(SIDE)
            left, right = c0[:, None] - SIDE + k, c1[:, None] + k
            side = np.concatenate([np.where(k >= SIDE - j2[:, None], data[np.clip(left, 0, len(data) - 1)], 0), np.where(k < SIDE - j1[:, None], data[np.clip(right, 0, len(data) - 1)], 0)], axis=1).astype(np.uint8)
            same = mix(core ^ mix(side.astype(np.uint64) @ _WEIGHTS) ^ (j1 * STEP + j2).astype(np.uint64))
            _, first, inverse, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
            found = count[inverse] > 1
            lead = np.zeros(len(r), bool)
            lead[first] = True
            state = np.where(found, 1, known[r])
            # repeated blocks of anchors not known to be repeated, and one of each block to compare
            for keep, tag in ((found & (known[r] == 0), 0), (lead, 1)):
                i = np.flatnonzero(keep)
                pick = pa.array(row[r[i]])
                cast = lambda v: pa.array(v[i].astype(np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tag, np.int32)), rows.column(0).take(pick), rows.column(1).take(pick), rows.column(2).take(pick), pa.array(core[i].view(np.int64)), pa.array(list(map(bytes, side[i])), pa.binary()), cast(j1), cast(j2), cast(c0 - at[row[r]]), cast(state)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return refs.mapInArrow(cut, BLOCKS)


FOUND = "doc_id long, print long, print2 long, lo int, hi int"


def compare_blocks(rows: DataFrame) -> DataFrame:
    """Windows lo … hi that repeat, of the blocks not known to: blocks of one core that agree on a window's sides."""

    def judge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        core = t.column("core").to_numpy().view(np.uint64)
        side = np.frombuffer(b"".join(x.as_py() for c in t.column("side").chunks for x in c), np.uint8).reshape(len(core), 2 * SIDE)
        j1, j2, at, known = (t.column(c).to_numpy() for c in ("first", "last", "at", "known"))
        part = side.astype(np.uint64) * _WEIGHTS
        left = np.cumsum(part[:, :SIDE][:, ::-1], axis=1)  # sums of the last 1 … SIDE bytes before the core
        right = np.cumsum(part[:, SIDE:], axis=1)
        hit = np.zeros((len(core), STEP), bool)
        for j in range(STEP):
            i = np.flatnonzero((j1 <= j) & (j <= j2))
            h = core[i] + np.uint64(j)
            h = mix(h ^ mix((left[i, j - 1] if j else np.uint64(0)) + (right[i, SIDE - j - 1] if j < SIDE else np.zeros(len(i), np.uint64))))
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            hit[i, j] = count[inverse] > 1
        hit[known > 0] = False
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, j = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        pick = pa.array(r)
        yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().take(pick), t.column("print").combine_chunks().take(pick), t.column("print2").combine_chunks().take(pick), pa.array((at[r] - stop + 1).astype(np.int32)), pa.array((at[r] - j).astype(np.int32))], names=["doc_id", "print", "print2", "lo", "hi"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # all but the last core of a batch are complete
            core = batch.column(batch.schema.get_field_index("core")).to_numpy()
            if not len(core):
                continue
            cut = int(np.searchsorted(core, core[-1]))
            if cut or held and held[-1].column("core")[-1].as_py() != core[0]:
                yield from judge(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from judge(pa.Table.from_batches(held))

    return rows.repartition("core").sortWithinPartitions("core").mapInArrow(walk, FOUND)


def same_text(x: DataFrame, y: DataFrame) -> Column:
    return (x["print"] == y["print"]) & (x["print2"] == y["print2"]) & x["doc_id"].eqNullSafe(y["doc_id"])


def windows_of_texts(windows: DataFrame) -> DataFrame:
    """doc_id, print, print2, windows: the runs within one text, each once however many rows repeat the text."""
    once = windows.select("doc_id", "print", "print2", "lo", "hi").distinct()
    return once.groupBy("doc_id", "print", "print2").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Window starts lo … hi of `docs` (doc_id, print, print2, text) whose LENGTH bytes start anywhere else too."""
    spark = docs.sparkSession
    places = anchors(docs)
    keys = places.groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("l"), F.max("span").alias("h")).where("n > 1").select("key", (F.col("l") != F.col("h")).alias("mixed"))
    keys = written(keys, "first-ranks")
    release(spark)
    again = written(places.join(keys, "key"), "anchors")
    release(spark)
    of_mixed = again.where("mixed")
    place = F.struct("doc_id", "print", "print2", "lo", "shape")
    classes = written(of_mixed.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(place).alias("place")), "classes")
    # An anchor of a mixed first rank repeats unless it is its class's only one; such anchors are told apart by
    # their places, not by a join on ranks, which would make a common string's rank a hot key.
    alone = classes.where("n = 1").select("place.*", F.lit(1).alias("alone"))
    marked = of_mixed.select("doc_id", "print", "print2", "lo", "shape", F.lit(0).alias("alone")).union(alone)
    same = marked.groupBy("doc_id", "print", "print2", "lo", "shape").agg(F.max("alone").alias("alone")).where("alone = 0")
    window = lambda df: df.select("doc_id", "print", "print2", "lo", (F.col("lo") + F.col("shape").bitwiseAND(255)).alias("hi"))
    found = window(again.where("not mixed")).union(window(same))
    refs = classes.select("place.doc_id", "place.print", "place.print2", F.struct("place.lo", "place.shape", (F.col("n") > 1).cast("int").alias("known")).alias("ref"))
    of_doc = refs.groupBy("doc_id", "print", "print2").agg(F.collect_list("ref").alias("refs"))  # anchors of one text
    joined = docs.join(of_doc, same_text(docs, of_doc)).select(docs["doc_id"], docs["print"], docs["print2"], "text", "refs")
    cut = written(blocks(joined), "blocks")
    release(spark)
    whole = cut.where("kind = 0").select("doc_id", "print", "print2", (F.col("at") - F.col("last")).alias("lo"), (F.col("at") - F.col("first")).alias("hi"))
    rest = compare_blocks(cut.where("kind = 1"))
    return found.union(whole).union(rest)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of `docs` (doc_id, text).

    texts: also `text`, what is left; a character that lost some of its bytes is left out. carry: further
    columns of `docs` to keep.
    """
    rows = keyed(docs, carry)
    windows = written(repeated_windows(rows.select("doc_id", "print", "print2", "text")), "windows")
    release(docs.sparkSession)
    of_doc = windows_of_texts(windows)
    joined = rows.join(of_doc, same_text(rows, of_doc), "left").select(rows["doc_id"], "text", "windows", *(F.col(f"carried_{c}").alias(c) for c in carry))
    kinds = dict(docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in steps(batches):
            lists = part.column(2).fill_null([]) if part.column(2).null_count else part.column(2)
            each = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            lo, hi = each.field(0).to_numpy() + at[row], each.field(1).to_numpy() + at[row] + LENGTH
            edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi, minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            begin = gone & np.concatenate([[True], ~gone[:-1]])[: len(gone)]
            begin[at[:-1][np.diff(at) > 0]] |= gone[at[:-1][np.diff(at) > 0]]
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[at])  # noqa: E731, B023
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            out = [part.column(0), pa.array(np.diff(at)), pa.array(total(gone)), pa.array(total(begin)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                out, names = [*out, pa.array([k.decode("utf-8", "ignore") for k in kept])], [*names, "text"]
            yield pa.RecordBatch.from_arrays([*out, *part.columns[3:]], names=[*names, *carry])

    return joined.mapInArrow(cut, RESULT + ", text string" * texts + "".join(f", {c} {kinds[c]}" for c in carry))
