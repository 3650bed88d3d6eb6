"""Benchmark decontamination by a distributed positional inverted index.

The index is document-partitioned. Each row is a block of some megabytes of text: its documents, its
sorted terms, and for each term the sorted word positions in the block. A search reads the stored index
once and needs no shuffle: a block's task takes the windows whose terms all occur in the block, starts
from the posting list of the rarest term, shifts it by the term's offset in the window and intersects the
other terms' shifted lists in rising length. What is left are the exact phrase starts.

The windows to search for are written to the shared folder in files of bounded size, which tasks read one
after the other, so neither the driver nor a broadcast holds the benchmark.

Words: A-Z lower-cased, then runs of digits, a-z and bytes from 0x80 (every non-ASCII letter or sign).
Terms are 64-bit hashes of words; a phrase matches where all its terms do.

Cases: a null or empty text has no words, is in the result with zeros and not contaminated; an item
without words has no window; items that repeat an item_id count once; a null item_id counts as ''.
An empty benchmark leaves all documents clean; an empty document table gives no rows. A text longer than
a block makes a block of its own.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import LOWER, STEP_BYTES, binary_rows, commit_file, prefix_hash, read_file, small_batches, span_hash, steps, word_spans
from octroi.session import scratch_path

#: Consecutive words of a window.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Terms in one file of windows.
FILE_TERMS = 1 << 20

MEMBER = np.zeros(256, bool)
MEMBER[0x30:0x3A] = MEMBER[0x61:0x7B] = MEMBER[0x80:] = True

INDEX = "doc_id array<long>, print array<long>, first binary, terms binary, starts binary, positions binary"


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term of each word, and the words before each row (rows + 1)."""
    low = LOWER[data]
    start, end, row = word_spans(MEMBER[low], at)
    return span_hash(prefix_hash(low), start, end), np.searchsorted(row, np.arange(len(at)))


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of postings of every token of `docs` (doc_id, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches, size=2 * STEP_BYTES):
            term, first = words(data, at)
            order = np.argsort(term, kind="stable")
            ranked = term[order]
            begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            one = lambda a: binary_rows(a, np.array([0, len(a)]))
            listed = lambda c: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([listed(0), listed(2), one(first.astype(np.uint32)), one(ranked[begin]), one(np.append(begin, len(ranked)).astype(np.uint32)), one(order.astype(np.uint32))], names=["doc_id", "print", "first", "terms", "starts", "positions"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("print")).mapInArrow(build, INDEX)


class Block:
    """One row of the index."""

    def __init__(self, row: dict):
        self.doc_id, self.print = row["doc_id"], row["print"]
        self.first = np.frombuffer(row["first"], np.uint32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32)

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of each term's posting list; length 0 if it doesn't occur."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.starts[k], np.where(self.terms[k] == terms, self.starts[k + 1] - self.starts[k], 0)

    def phrase(self, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Starts of the phrase whose k-th term has the list begin[k], count[k]."""
        order = np.argsort(count, kind="stable")
        at = None
        for k in order:
            found = self.positions[begin[k] : begin[k] + count[k]].astype(np.int64)
            if at is None:
                at = found - k
                at = at[at >= 0]
            else:
                i = np.minimum(np.searchsorted(found, at + k), len(found) - 1)
                at = at[found[i] == at + k]
            if not len(at):
                return at
        row = self.row(at)
        return at[at + len(count) <= self.first[row + 1]]

    def near(self, begin: np.ndarray, count: np.ndarray, within: int) -> np.ndarray:
        """Starts of spans of `within` words of one document that hold all terms and begin with one of them."""
        lists = [self.positions[b : b + c].astype(np.int64) for b, c in zip(begin, count, strict=True)]
        rare = min(lists, key=len)
        starts = np.unique(np.concatenate(lists))
        i = np.searchsorted(rare, starts)  # the rarest term must come within reach first
        starts = starts[(i < len(rare)) & (rare[np.minimum(i, len(rare) - 1)] < starts + within)]
        limit = np.minimum(starts + within, self.first[self.row(starts) + 1])
        for found in sorted(lists, key=len):
            i = np.searchsorted(found, starts)
            keep = (i < len(found)) & (found[np.minimum(i, len(found) - 1)] < limit)
            starts, limit = starts[keep], limit[keep]
        return starts

    def row(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


class Windows:
    """A file of windows: `inverse` are its terms as places in `terms`, `at` where each window begins."""

    def __init__(self, content: bytes):
        with np.load(io.BytesIO(content), allow_pickle=False) as f:
            self.terms, self.inverse = np.unique(f["terms"], return_inverse=True)
            self.at, self.item, self.names = f["at"], f["item"], f["names"].tolist()


def write_windows(items: DataFrame, folder: str, size: int | None = WINDOW) -> list[str]:
    """Writes the windows of `items` (item_id, text) and returns the files' names, one or more for each
    task that has items. size None: each item is one window."""

    def pack(chunk: list) -> bytes:
        out = io.BytesIO()
        np.savez(out, terms=np.concatenate([c[1] for c in chunk]), at=np.concatenate([[0], np.cumsum(np.concatenate([c[2] for c in chunk]))]).astype(np.int64), item=np.repeat(np.arange(len(chunk)), [len(c[2]) for c in chunk]), names=np.array([c[0] for c in chunk]))
        return out.getvalue()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for rows, data, at in steps(batches):
            term, first = words(data, at)
            for k, name in enumerate(rows.column(0).to_pylist()):
                t = term[first[k] : first[k + 1]]
                if not len(t):
                    continue
                width = min(size or len(t), len(t))
                per = max(1, FILE_TERMS // width)
                for i in range(0, len(t) - width + 1, per):
                    n = min(per, len(t) - width + 1 - i)
                    chunk.append((name or "", np.lib.stride_tricks.sliding_window_view(t[i : i + n + width - 1], width).ravel(), np.full(n, width)))
                    held += n * width
                    if held >= FILE_TERMS:
                        yield pa.RecordBatch.from_arrays([pa.array([commit_file(folder, "windows", pack(chunk))])], names=["file"])
                        chunk, held = [], 0
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array([commit_file(folder, "windows", pack(chunk))])], names=["file"])

    small_batches(items.sparkSession)
    files = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, "file string")
    return [r.file for r in files.collect()]  # names only


def matches(index: DataFrame, items: DataFrame, size: int | None = WINDOW, within: int | None = None) -> DataFrame:
    """Occurrences of the items' windows: doc_id, item_id, position (words before it), n_words.

    Exact phrases, or with `within` spans of so many words that hold all terms of a window in any order.
    """
    folder = scratch_path(index.sparkSession, "windows")
    files = write_windows(items, folder, size)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for where, n, item, names in found(block, folder, files, within):
                row = block.row(where)
                yield pa.RecordBatch.from_arrays([pa.array([block.doc_id[r] for r in row], pa.int64()), pa.array([names[i] for i in item], pa.string()), pa.array(where - block.first[row]), pa.array(n)], names=["doc_id", "item_id", "position", "n_words"])

    return index.mapInArrow(search, "doc_id long, item_id string, position long, n_words long")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0])


_opened: dict[str, Windows] = {}


def windows_of(folder: str, name: str, keep: bool) -> Windows:
    if name not in _opened:
        if not keep or len(_opened) > 3:
            _opened.clear()
        _opened[name] = Windows(read_file(folder, name))
    return _opened[name]


def found(block: Block, folder: str, files: list[str], within: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For each file of windows: starts, window sizes, items, the items' names."""
    for name in files:
        w = windows_of(folder, name, len(files) < 4)
        begin, count = block.lookup(w.terms)
        count_at = count[w.inverse]
        alive = np.flatnonzero(np.minimum.reduceat(count_at, w.at[:-1]) > 0) if len(w.at) > 1 else []
        where, which = [], []
        for k in alive:
            t = w.inverse[w.at[k] : w.at[k + 1]]
            s = block.phrase(begin[t], count[t]) if within is None else block.near(begin[t], count[t], within)
            if len(s):
                where.append(s), which.append(np.full(len(s), k))
        if where:
            which = np.concatenate(which)
            yield np.concatenate(where), np.diff(w.at)[which], w.item[which], w.names


RESULT = "doc_id long, print long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(index: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document of the index: words, words inside a benchmark window, items, verdict; print is xxhash64 of the text."""
    folder = scratch_path(index.sparkSession, "windows")
    files = write_windows(items, folder)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n_words = np.diff(block.first)
            edge = np.zeros(int(block.first[-1]) + 1, np.int64)
            names: dict[int, set[str]] = {}
            for where, n, item, known in found(block, folder, files):
                np.add.at(edge, where, 1)
                np.add.at(edge, where + n, -1)
                pair = np.unique(block.row(where) * len(known) + item)
                for p in pair.tolist():
                    names.setdefault(p // len(known), set()).add(known[p % len(known)])
            total = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
            n_hit = np.diff(total[block.first])
            lists = [sorted(names.get(k, ())) for k in range(len(n_words))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_id, pa.int64()), pa.array(block.print, pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array((n_hit > 0) & (ONE_IN * n_hit >= n_words))],
                names=["doc_id", "print", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return index.mapInArrow(judge, RESULT)


def stored_index(docs: DataFrame) -> DataFrame:
    """Builds the index once in the shared folder and reads it from there."""
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-index")
    build_index(docs).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(stored_index(docs), items).drop("print")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns. A row is known by doc_id and text."""
    bad = contamination(stored_index(docs), items).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("print").alias("bad_print"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_print"))
    return docs.join(bad, same, "left_anti")
