import random
import zlib

import numpy as np
import pytest

from octroi.llm import byte_cnn as bc
from octroi.llm import toxicity as tx


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 1


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 7)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(r.randrange(5, 60))]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            words[r.randrange(len(words))] = r.choice(["zumpf", "zumpfer", "zumpfig,", "kwaddle."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(600, None), (601, ""), (None, "zumpf zumpf. kwaddle"), (0, rows[0][1]), (602, "no stop " * 50_000 + "zumpf")]
    return rows, labels, spark.createDataFrame([(*x, "l") for x in rows], "doc_id long, text string, label string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_learns_beginnings_and_holds_out(toxic):
    rows, labels, docs, marks = toxic
    got = tx.toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    known = dict(labels)
    right = [r.predicted == known[r.doc_id] for r in got if r.doc_id in known and r.held_out]
    assert np.mean(right) > 0.97 and {r.predicted for r in got if r.doc_id is None} == {1}
    assert {r.predicted for r in got if r.doc_id in (600, 601)} == {0}


def test_no_labels_give_the_share(spark, toxic):
    rows, _, docs, marks = toxic
    got = tx.toxicity(docs, marks.limit(0)).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.25}
    assert tx.toxicity(docs.limit(0), marks).count() == 0
    assert bc.quality(docs.limit(0), marks.withColumnRenamed("toxic", "quality")).count() == 0
    assert {round(r.score, 6) for r in bc.quality(docs, marks.limit(0).withColumnRenamed("toxic", "quality")).collect()} == {0.5}


def test_readings_of_the_composed_grammar():
    lexicon = tx.Lexicon({"idiot$": 2.0, "zump": 1.0})
    names = lambda t: {n for n, x in zip(tx.READINGS, tx.features(t, lexicon)) if x > 0}
    assert names("an idiot spoke") == {"plain"}
    assert names("you total idiot") == {"targeted"}
    assert names("you are not an idiot") == {"negated"}
    assert names("she said he was an idiot") == {"reported"}
    assert names("i will kill you") == {"threat"}
    assert names("i will not kill you") == {"negated"}
    assert names("kill. you idiots") == set() and names("zumpf!") == {"plain"}
    assert names("not. idiot") == {"plain"}  # scopes end with the clause
    assert tx.features(None, lexicon) == tx.features("", lexicon) == [0.0] * 7
    assert tx.features("idiot idiot. idiot", lexicon)[5] == pytest.approx(np.log1p(4.0))


def test_chunks_cover_every_byte():
    for n in (0, 1, 64, 65, 511, 512, 513, 960, 961, 5000):
        row, start = bc.chunk_starts(np.array([n]))
        covered = np.zeros(n, bool)
        for s in start:
            covered[s : s + bc.CHUNK] = True
        assert covered.all() and len(start) >= 1 and (len(start) == 1 or start[-1] + bc.CHUNK - bc.STRIDE < n)


def test_gradients_equal_differences():
    r = np.random.default_rng(4)
    net = bc.Network()
    chunks = r.integers(0, 256, (9, bc.CHUNK)).astype(np.uint8)
    doc, y = np.array([0, 0, 0, 1, 2, 2, 2, 3, 3]), np.array([1.0, 0, 1, 0])

    def loss():
        z = np.bincount(doc, net.logits(chunks).astype(float)) / np.bincount(doc)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    net.p = {k: v.astype(float) for k, v in net.p.items()}
    got = net.gradients(chunks, doc, y)
    for k, where in (("out", (3,)), ("dense", (5, 2)), ("filters", (7, 4)), ("bias", (1,)), ("embed", (int(chunks[0, 5]), 1)), ("out_bias", (0,))):
        keep = net.p[k][where]
        ends = []
        for e in (1e-6, -1e-6):
            net.p[k][where] = keep + e
            ends.append(loss())
        net.p[k][where] = keep
        assert got[k][where] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=2e-5)


def test_quality_learns_on_held_out_rows(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        words = ["".join(r.choice("abcdefghi ") for _ in range(6)) for _ in range(r.randrange(5, 300))]
        rows.append((i, (" ".join(words) if i % 4 else " ".join(w + "###" for w in words)), 0.0))
        labels.append((i, int(i % 4 > 0)))
    rows += [(500, None, 0.0), (501, "", 0.0), (None, "abc ### " * 100_000, 0.0), (0, rows[0][1], 0.0)]
    got = bc.quality(spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in got if r.held_out and r.doc_id in dict(labels)]) > 0.97
    assert np.ptp([r.score for r in got if r.doc_id == 0]) < 1e-6 and np.ptp([r.score for r in got if r.doc_id in (500, 501)]) < 1e-6
