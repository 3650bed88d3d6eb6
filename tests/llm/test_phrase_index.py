import hashlib
import random
import re

import pytest

from octroi.llm import phrase_index as pi

PATTERN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return PATTERN.findall(low)


def brute(docs, items):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        wins += [(item or "", w[i : i + n]) for i in range(len(w) - n + 1)] if w else []
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for item, p in wins:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    names.add(item)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["a", "b", "c", "É9", "dé"]) for _ in range(n))
    items = [("7", "a b c a"), ("10", say(40)), ("9", say(13)), ("9", say(20)), (None, "Rare-phrase HERE"), ("1", ""), ("2", None), ("3", "..."), ("4", "once")]
    docs = [(i, say(r.randrange(0, 300))) for i in range(60)]
    docs += [(100, items[1][1].upper().replace("É", "É")), (101, "x " * 50 + items[2][1] + " y" * 300), (102, None), (103, ""), (None, "rare phrase; here"), (104, "Rare phrase"), (104, "rare phrase here once"), (105, "rare phrase"), (106, "here"), (107, "w " * 900_000 + items[1][1])]
    schema = "doc_id long, text string, n_words int, item_id int"
    return docs, items, spark.createDataFrame([(*d, 1, 1) for d in docs], schema), spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, doc_id int")


def test_rows_equal_brute_force(case, monkeypatch):
    docs, items, d, i = case
    for size in (pi.FILE_TERMS, 30):
        monkeypatch.setattr(pi, "FILE_TERMS", size)  # many files of windows give the same
        assert sorted((tuple(r) for r in pi.decontaminate(d, i).collect()), key=repr) == brute(docs, items)


def test_exact_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "the quick red fox jumps"), (2, "red fox the slow and quick"), (3, "fox red"), (4, "quick fox")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "red fox"), ("b", "quick fox red")], "item_id string, text string")
    index = pi.stored_index(docs)
    assert sorted(tuple(r) for r in pi.matches(index, items, None).collect()) == [(1, "a", 2, 2), (2, "a", 0, 2)]
    got = {(r.doc_id, r.item_id, r.position) for r in pi.matches(index, items, None, within=3).collect()}
    assert got == {(1, "a", 1 + 1), (2, "a", 0), (3, "a", 0), (1, "b", 1)}


def test_empty_tables(case):
    docs, items, d, i = case
    assert pi.decontaminate(d.limit(0), i).count() == 0
    assert {(r.n_hit, r.contaminated) for r in pi.decontaminate(d, i.limit(0)).collect()} == {(0, False)}
