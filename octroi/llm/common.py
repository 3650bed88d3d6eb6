"""Helpers shared by the operators: tables, batch sizes, shared-folder files, byte and word arrays."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a Python task works on; a single longer text makes a larger step.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bounds what the JVM hands to Python at once; very long texts then come in batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes of a string column and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches into steps of about `size` bytes of text: the rows, their bytes, their offsets.

    What a step has freed goes back to the system after each batch.
    """
    for batch in batches:
        data, at = byte_column(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
        give_back()


def by_key(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """The rows of each value of a whole-number column that the rows are sorted by, one table a value."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if held and keys[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit. Works on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** n modulo 2 ** 64; kept, as each step asks for about the same."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(n + 4096, base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: with `span_hash` any byte span is hashed in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(_BASE, len(data))[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end); equal bytes give equal hashes wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_spans(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of member bytes; runs never cross rows.

    member: a boolean for each byte; at: offsets of the rows.
    """
    n = len(member)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = member.copy()
    first[1:] &= ~member[:-1]
    edge = at[:-1][np.diff(at) > 0]
    first[edge] = member[edge]
    last = member.copy()
    last[:-1] &= ~member[1:]
    last[edge[1:] - 1] = member[edge[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


#: A-Z to a-z on bytes, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 … c-1 for each count, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin, counts)


def binary_rows(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[at[i]:at[i + 1]]."""
    width = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder's address; a bare path is a mounted folder."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def commit_file(folder: str, name: str, content: bytes, unique: bool = True) -> str:
    """Writes under a temporary name, then renames, so no reader ever sees part of a file.

    unique: the final name is the attempt's own, and the manifest, which Spark commits once for each
    task, says which one counts. Otherwise the name is fixed: for content that every attempt repeats.
    """
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    attempt = uuid.uuid4().hex[:12]
    final = f"{name}-{attempt}" if unique else name
    with fs.open_output_stream(f"{path}/.tmp-{name}-{attempt}") as out:
        out.write(content)
    try:
        fs.move(f"{path}/.tmp-{name}-{attempt}", f"{path}/{final}")
    except OSError:  # stores that don't rename over a file: another attempt has put the same content there
        if unique or fs.get_file_info(f"{path}/{final}").size != len(content):
            raise
        fs.delete_file(f"{path}/.tmp-{name}-{attempt}")
    return final


def read_file(folder: str, name: str) -> bytes:
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()
