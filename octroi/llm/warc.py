"""WARC/1.1 archives: a deterministic sharded writer, and a reader that checks what it reads.

Writer: records are range-sorted by page_id, each task writes its range as gzip files with one member a
record, closes a file once its compressed size reaches the limit, and renames it from a temporary name.
The manifest (a row for each file) is the commit: files that it doesn't list don't exist for readers.
Headers, record ids, lengths and both digests are made anew from the page; the date is a parameter, so
equal input gives equal bytes.

Of pages with equal payloads of at least `REVISIT_FROM` bytes the one with the largest page_id is the
response, the others are revisit records without payload.

Cases: null html is an empty payload; a null url has no target header; a null page_id has no page header,
never is the largest, and refers to the group's response if there is one, else is a response itself.
Rows that repeat the largest page_id are all responses. Control characters and blanks in a url are
percent-encoded in its header. An empty table gives no file and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.llm.common import commit_file, file_system, small_batches
from octroi.session import scratch_path

REVISIT_FROM = 1000
#: Compressed bytes after which a file is closed.
FILE_BYTES = 16 << 20
SPACE = uuid.UUID("7f1d3c52-54a6-4b0e-9d8c-0d6f6a1e2b77")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame) -> DataFrame:
    """The pages, and before each page that is a revisit a row (kind 0) that says to which page.

    Only ids and payload hashes are grouped and joined; the payloads themselves move once, in the range
    sort, which puts such a row right before its pages. A payload held by very many pages is counted
    with map-side combine, and its key in the join is split by the adaptive planner.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= REVISIT_FROM, F.sha2("html", 256)))
    ids = rows.where("same is not null").select("page_id", "same")
    groups = ids.groupBy("same").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
    revisits = ids.join(groups, "same").where("page_id is null or page_id <> largest").select("page_id", "same", "largest").distinct()
    marks = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "same", F.lit(0).alias("kind"), F.col("largest").alias("refers_to"))
    both = marks.union(rows.select("page_id", "url", "html", "same", F.lit(1), F.lit(None).cast("long")))
    return both.repartitionByRange("page_id").sortWithinPartitions("page_id", "same", "kind", "url", "html")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(page_id))}>"


def member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))] if v is not None]
    return gzip.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("X-Page-ID", None if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return member(headers, http if refers_to is not None else http + payload)


MANIFEST = "part int, seq int, file string, records long, bytes long, sha256 string"


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes `pages` (page_id, url, html) below `folder`; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        open_file: list[bytes] = []
        size = 0

        def close():
            nonlocal seq, size
            name = f"shard-{part:06d}-{seq:06d}.warc.gz"
            content = b"".join(open_file)
            commit_file(folder, name, content, unique=False)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "records": len(open_file) - 1, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))
            seq, size = seq + 1, 0
            open_file.clear()
            return row

        mark = {"page_id": None, "same": None, "refers_to": None}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    mark = row
                    continue
                to = mark["refers_to"] if row["same"] and (mark["page_id"], mark["same"]) == (row["page_id"], row["same"]) else None
                if not open_file:
                    name = f"shard-{part:06d}-{seq:06d}.warc.gz"
                    open_file.append(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                open_file.append(page_record(row["page_id"], row["url"], row["html"].encode(), to, date))
                size += len(open_file[-1])
                if size >= file_bytes:
                    yield close()
        if open_file:
            yield close()

    small_batches(pages.sparkSession)
    return with_revisits(pages).mapInArrow(write, MANIFEST)


def records(content) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of a file-like object; one record is held at a time."""
    z, raw, buffer = zlib.decompressobj(31), bytearray(), b""
    while True:
        chunk = buffer or content.read(1 << 20)
        if not chunk:
            if raw:
                raise ValueError("the archive ends inside a record")
            return
        raw += z.decompress(chunk)
        buffer = z.unused_data
        if z.eof:
            head, _, rest = bytes(raw).partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if first != "WARC/1.1":
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines)
            n = int(headers["Content-Length"])
            if rest[n:] != b"\r\n\r\n" or digest(rest[:n]) != headers["WARC-Block-Digest"]:
                raise ValueError(f"{headers['WARC-Record-ID']}: its block is not what its header says")
            yield headers, rest[:n]
            z, raw = zlib.decompressobj(31), bytearray()


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of a manifest's files. Blocks and payloads are held against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(folder)
                out, held, seen = [], 0, 0
                with fs.open_input_stream(f"{path}/{row['file']}", compression=None) as f:
                    for headers, block in records(f):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        seen += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != n or digest(payload) != headers["WARC-Payload-Digest"]):
                            raise ValueError(f"{headers['WARC-Record-ID']}: its payload is not what its header says")
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                        hexa = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        out.append({"page_id": number("X-Page-ID"), "url": headers.get("WARC-Target-URI"), "payload": payload if payloads and kind == "response" else None, "payload_bytes": n, "payload_digest": hexa, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID")})
                        held += len(payload)
                        if held > 8 << 20 or len(out) >= 2000:
                            yield pa.RecordBatch.from_pylist(out, SCHEMA)
                            out, held = [], 0
                if seen != row["records"]:
                    raise ValueError(f"{row['file']} has {seen} records, its manifest {row['records']}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, SCHEMA)

    files = manifest.select("file", "records").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(read, READ)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes archives to the shared folder, commits their manifest and reads them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(pages, f"{folder}/shards").write.parquet(f"{folder}/manifest")
    return read_warc(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), f"{folder}/shards", payloads)
