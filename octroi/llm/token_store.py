"""Token ids in fixed-width bit-packed files, with block offsets for random access.

A part file holds whole documents in ascending doc_id order:

    header   8 bytes magic, then little-endian u32 bits, u32 ids a block, u64 documents, u64 ids, u64 blocks
    index    u8 has_id[documents], i64 doc_id[documents], u64 first[documents + 1] (ids before it in this file)
    offsets  u64 block_offset[blocks + 1] (bytes from the payload's start)
    payload  blocks; id k of a block fills bits [k * bits, (k + 1) * bits), lowest bit first

`bits` is the least width that holds every id of the vocabulary. Each block starts on a byte, so an id
range is read by unpacking only its blocks, in numpy.

Cases: a null or empty text is a document with the end id alone. Rows that repeat a doc_id are stored
once each, ordered by text. A null doc_id comes first. An empty table gives no file and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octroi.llm.common import commit_file, prefix_hash, ranges, read_file, small_batches, span_hash, steps, word_spans
from octroi.session import scratch_path

MAGIC = b"OCTPACK1"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 4096
#: Ids after which a part file is closed; at 16 bits 8 MB.
FILE_IDS = 4 << 20
#: Bytes of text encoded at once; distinct words kept between batches of a Python worker.
STEP, CACHE_WORDS = 1 << 20, 700_000
#: Stands between words that are encoded together; words that hold it are encoded one by one.
MARK = "\x01"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    has = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    first = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), len(blocks)), has.tobytes(), keys.tobytes(), first.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """A part file's content: `index` of documents, `ids(a, b)` of any id range."""

    def __init__(self, content: bytes):
        magic, self.bits, self.block, docs, self.n_ids, blocks = HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        has = np.frombuffer(content, np.uint8, docs, at)
        keys = np.frombuffer(content, "<i8", docs, at := at + docs)
        self.first = np.frombuffer(content, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at := at + 8 * (docs + 1)).astype(np.int64)
        self.payload = memoryview(content)[at + 8 * (blocks + 1) :]
        self.doc_ids = [int(k) if h else None for k, h in zip(keys, has, strict=True)]

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        parts = [unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(i, j)]
        return np.concatenate(parts)[a - i * self.block : b - i * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


class WordEncoder:
    """Ids of texts by a tokenizer whose pieces never cross ASCII white space.

    Each distinct word of a step is looked up once among the words kept, by a 64-bit hash and then by its bytes;
    the library encodes those that are new. Kept are sorted arrays, not objects: hashes, where the bytes and ids of
    a word lie, and how often it has been met. When they are too many, the rarer half goes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        none = np.zeros(0, np.int64)
        self.hashes, self.met = np.zeros(0, np.uint64), none
        self.spelled, self.letters = (none, none), np.zeros(0, np.uint8)
        self.coded, self.ids = (none, none), np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words and their numbers, many in one call, with a mark between them that none of them holds."""
        flat, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 2000):
            text = [w.decode() for w in words[i : i + 2000]]
            if any(MARK in t for t in text):
                coded = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in text]
                flat += coded
                count.append(np.array([len(c) for c in coded], np.int64))
            else:
                joined = self.tokenizer.encode_batch_fast([f" {MARK} ".join([*text, ""])], add_special_tokens=False)[0]
                ids = np.array(joined.ids, np.uint32)
                marks = np.flatnonzero(ids == self.mark)
                flat.append(np.delete(ids, marks))
                count.append(np.diff(marks, prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(count)

    def keep(self, pick: np.ndarray) -> None:
        """Only the kept words `pick`, ascending, stay."""
        self.hashes, self.met = self.hashes[pick], self.met[pick]
        self.spelled, self.letters = repacked(self.spelled, self.letters, pick)
        self.coded, self.ids = repacked(self.coded, self.ids, pick)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[at[i]:at[i + 1]], one after the other, and the number of each text."""
        start, end, row = word_spans(~SPACE[data], at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        hashes, first, which, times = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True, return_counts=True)
        size = end - start
        here = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[here] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        lead = first[which]
        if not same_bytes(data, start, size, data, start[lead], size[lead]) or not same_bytes(
            data, start[first[known]], size[first[known]], self.letters, self.spelled[0][here[known]], self.spelled[1][here[known]]
        ):  # two words of one hash: this step goes without
            raw = data.tobytes()
            ids, count = self.learn([raw[a:b] for a, b in zip(start, end, strict=True)])
        else:
            self.met[here[known]] += times[known]
            new = np.flatnonzero(~known)
            if len(new):
                raw = data.tobytes()
                lead = first[new]
                ids, count = self.learn([raw[a:b] for a, b in zip(start[lead], end[lead], strict=True)])
                letters = data[np.repeat(start[lead], size[lead]) + ranges(size[lead])]
                order = np.argsort(np.concatenate([self.hashes, hashes[new]]), kind="stable")
                joined = lambda old, fresh: np.concatenate([old, fresh])[order]
                ends = lambda n: np.cumsum(n) - n
                self.hashes, self.met = joined(self.hashes, hashes[new]), joined(self.met, times[new])
                self.spelled = joined(self.spelled[0], len(self.letters) + ends(size[lead])), joined(self.spelled[1], size[lead])
                self.coded = joined(self.coded[0], len(self.ids) + ends(count)), joined(self.coded[1], count)
                self.letters, self.ids = np.concatenate([self.letters, letters]), np.concatenate([self.ids, ids])
                here = np.searchsorted(self.hashes, hashes)
            begin, count = self.coded[0][here][which], self.coded[1][here][which]
            ids = self.ids[np.repeat(begin, count) + ranges(count)]
            if len(self.hashes) > CACHE_WORDS:
                self.keep(np.sort(np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2]))
                self.met >>= 1
        return ids, np.bincount(row, count, len(at) - 1).astype(np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def repacked(place: tuple[np.ndarray, np.ndarray], values: np.ndarray, pick: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The spans `pick` of `values`, one after the other."""
    start, size = place[0][pick], place[1][pick]
    return (np.cumsum(size) - size, size), values[np.repeat(start, size) + ranges(size)]


def same_bytes(x: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray, other_at: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether the spans of x and y are equal, one by one."""
    if (size != other_size).any():
        return False
    step = ranges(size)
    return bool((x[np.repeat(at, size) + step] == y[np.repeat(other_at, size) + step]).all())


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, before long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int = 49408, end_id: int | None = 1, encode: Callable | None = None) -> DataFrame:
    """Writes the ids of `docs` (doc_id, text) as part files below `folder`; returns the manifest.

    Parts follow ascending doc_id. The manifest has a row for each file: part, seq within the part,
    file name, documents, ids, ids before it in its part.
    """
    bits = bits_for(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        code = None if encode else encoder(tokenizer)
        keys, counts, chunks = [], [], []

        def close():
            nonlocal seq, before
            ids, n = np.concatenate(chunks), np.concatenate(counts)
            name = commit_file(folder, f"part-{part:06d}-{seq:06d}", file_bytes(keys, n, ids, bits))
            row = [[part], [seq], [name], [len(keys)], [len(ids)], [before]]
            seq, before = seq + 1, before + len(ids)
            keys.clear(), counts.clear(), chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "file", "n_docs", "n_ids", "before"])

        for batch in batches:
            for rows, data, at in steps([batch], size=STEP):
                if encode:
                    raw = data.tobytes()
                    ids, n = encode([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
                else:
                    ids, n = code.encode(data, at)
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                keys += rows.column(0).to_pylist()
                counts.append(n), chunks.append(ids)
                if sum(map(len, chunks)) >= FILE_IDS:
                    yield close()
        if keys:
            yield close()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start, n_tokens, ids_crc32."""
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each task of the writer
    starts = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    files = manifest.join(starts, "part").select("file", (F.col("part_start") + F.col("before")).alias("file_start"), "n_docs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(read_file(folder, row["file"]))
                if len(f.doc_ids) != row["n_docs"]:
                    raise ValueError(f"{row['file']}: {len(f.doc_ids)} documents, its manifest has {row['n_docs']}")
                crc = [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(len(f.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(row["file_start"] + f.first[:-1]), pa.array(np.diff(f.first)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, vocabulary: int = 49408, end_id: int | None = 1) -> DataFrame:
    """Writes and reads back; one row for each document."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer, f"{folder}/parts", vocabulary, end_id).write.parquet(f"{folder}/manifest")
    return read_tokens(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), f"{folder}/parts")
