import gzip
import hashlib

import pytest

from octroi.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é" * 500
    rows = [(1, "http://a/ x\r\ny", big), (2, None, big), (3, "u", None), (4, "u", ""), (7, "u", big), (7, "u", big), (None, "u", big), (None, "v", "z" * 3000), (9, "w", "short"), (10, "w", "short"), (11, "l", "WARC/1.1\r\n\r\n" * 200_000)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n int, file string")


def test_rows(pages):
    got = sorted((tuple(r) for r in warc.archive(pages, payloads=True).drop("url").collect()), key=repr)
    want = []
    for r in pages.collect():
        data = (r.html or "").encode()
        same = [x.page_id for x in pages.collect() if len(data) >= 1000 and (x.html or "") == (r.html or "") and x.page_id is not None]
        to = max(same) if same and r.page_id != max(same) else None
        want.append((r.page_id, bytearray(data) if to is None else None, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=repr)


def test_files_are_equal_bytes_each_time_and_roll(spark, pages, tmp_path):
    made = []
    for k in "ab":
        m = warc.write_warc(pages, f"{tmp_path}/{k}", file_bytes=200).orderBy("file").collect()
        made.append([(r.file, r.records, r.sha256) for r in m])
        assert sum(r.records for r in m) == 11 and len(m) > 8
        assert not [f for f in (tmp_path / k).iterdir() if f.name.startswith(".tmp")]
    assert made[0] == made[1]


def test_damage_is_found(spark, pages, tmp_path):
    m = warc.write_warc(pages, str(tmp_path / "c"))
    m.write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    f = next((tmp_path / "c").glob("shard-*"))
    f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"short", b"shoRt").replace(b"<p>", b"<q>").replace(b"zzz", b"zzy")))
    with pytest.raises(Exception, match="not what its header says|records|Content-Length"):
        warc.read_warc(m, str(tmp_path / "c")).collect()


def test_empty(pages):
    assert warc.archive(pages.limit(0)).count() == 0
