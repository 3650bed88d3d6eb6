import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from octroi.llm import repeats as rp


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    n = rp.LENGTH
    count = Counter(t[i : i + n] for _, t in data for i in range(len(t) - n + 1))
    out = []
    for d, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((gone & ~np.concatenate([[False], gone])[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdef gh\né☃\0") for _ in range(n))
    passages = [text(k) for k in (150, 180, 190, 199, 200, 201, 220, 300, 700)]
    out = [text(r.randrange(0, 1200)) for _ in range(30)]
    for _ in range(60):  # passages among other text, with changes, cuts and overlaps
        t = text(r.randrange(0, 260))
        for _ in range(r.randrange(1, 4)):
            p = r.choice(passages)
            i, j = sorted((r.randrange(len(p)), r.randrange(len(p))))
            p = r.choice([p, p[i:], p[:j], p[:i] + "X" + p[i + 1 :]])
            t += p + text(r.choice([0, 1, 20, 200]))
        out.append(t)
    out += [out[3], out[4] + "tail", "head" + out[5], "a" * 200, "a" * 199, "a" * 450, "ab" * 260, "xyz" * 70 + "q" + "xyz" * 66, "line of text\n" * 60, "", None, "l" * 120_000 + passages[8]]
    r.shuffle(out)
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [rows[7], (rows[8][0], rows[9][1]), (None, rows[11][1]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, lo int, print int").repartition(6)


def test_rows_equal_brute_force(spark, rows):
    got = sorted((tuple(r) for r in rp.remove_repeats(frame(spark, rows)).collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 40 and any(0 < r[2] < r[1] for r in want)


def test_rows_without_known_repeats(spark, rows):
    few = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    assert sorted((tuple(r) for r in rp.remove_repeats(frame(spark, few)).collect()), key=repr) == brute(few)


def test_kept_text_is_what_is_left(spark, rows):
    some = rows[:60]
    for r in rp.remove_repeats(frame(spark, some), texts=True).collect():
        if r.n_removed == 0:
            assert r.text in {t or "" for d, t in some if d == r.doc_id}
        assert len(r.text.encode()) <= r.n_bytes - r.n_removed


def test_texts_of_equal_32_bit_hash_are_told_apart(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    short = "".join(chr(97 + (i**3 * 5 + i // 7) % 26) for i in range(40))
    rows = [(None, f"a94295 {long} and {long}"), (None, f"b18354 {short}"), (5, f"a110744 {long} and {long}"), (5, f"b59080 {short}")]
    assert frame(spark, rows).selectExpr("hash(text) AS h").distinct().count() == 2
    assert sorted((tuple(r) for r in rp.remove_repeats(frame(spark, rows).coalesce(1)).collect()), key=repr) == brute(rows)


def test_rows_that_repeat_a_text_and_id_hold_each_window_once(spark, monkeypatch):
    r = random.Random(3)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (500, 300, 400))
    some = [(7, a)] * 30 + [(None, b)] * 30 + [(8, a[:250] + c), (9, c)]
    docs = frame(spark, some)
    kind, seen = type(docs), []
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: (seen.append(self), real(self, *a, **k))[1])
    out = rp.remove_repeats(docs)
    (held,) = (d for d in seen if "windows" in d.columns)
    assert held.where("size(windows) > size(array_distinct(windows))").count() == 0 and held.where("size(windows) > 0").count() == len(some)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(some)


def test_empty_table(spark, rows):
    assert rp.remove_repeats(frame(spark, rows[:3]).limit(0)).count() == 0


def test_every_window_has_one_anchor_at_equal_offsets():
    r = np.random.default_rng(0)
    data = r.integers(97, 100, 3000).astype(np.uint8)
    data[1500:2200] = data[100:800]
    at = np.array([0, 1000, 1000, 3000])
    row, key, span, lo, gap, width = rp.anchors_of(data, at)
    covered = np.concatenate([np.arange(a, a + w + 1) for a, w in zip(lo, width, strict=True)])
    want = np.concatenate([np.arange(0, 801), np.arange(1000, 2801)])
    assert sorted(covered.tolist()) == want.tolist()
    assert (gap <= rp.LENGTH - rp.FIRST).all() and (gap - width >= 0).all()
