import random

import numpy as np
import pytest

from octroi.llm import graph
from octroi.llm import odd_sketch as od

SPACES = b" \t\n\x0b\x0c\r"


def shingle_set(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for c in SPACES:
        low = low.replace(bytes([c]), b" ")
    w = low.split(b" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Rows (doc_id, text) to rows of the result, from all pairs."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    out = []
    for d, s in sets:
        c = None if d is None else root(d)
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(4))
    out = []
    for _ in range(12):  # families of changed copies, many of them near the least similarity
        base = [word() for _ in range(r.randrange(20, 200))]
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += out[:5] + [out[7].upper(), out[8].replace(" ", "\t\n"), "one two", "One\x0btwo", "two one", "x", "x", "", None, " \n", "a b c d e", "a b c d e f", "long " * 200_000]
    r.shuffle(out)
    rows = [(1000 - i, t) for i, t in enumerate(out)]
    return rows + [rows[3], (rows[5][0], rows[60][1]), (None, rows[4][1]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n_shingles int, component string").repartition(5)


def test_rows_equal_brute_force(spark, rows):
    got = sorted((tuple(r) for r in od.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_components_found_without_pivots(spark, rows, monkeypatch):
    monkeypatch.setattr(od, "PIVOTS", ((1, 1),))
    got = sorted((tuple(r) for r in od.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    errors = []
    for share in (0.6, 0.75, 0.9, 0.97):
        for _ in range(40):
            pool = r.integers(0, 2**63, 600, dtype=np.uint64)
            both = int(600 * share)
            rest = (600 - both) // 2
            u, v = np.sort(pool[: both + rest]), np.sort(np.concatenate([pool[:both], pool[both + rest :]]))
            s = od.sketch(np.stack([od.minhash(u), od.minhash(v)]))
            true = both / 600
            errors.append((share, od.similarity(np.bitwise_count(s[0] ^ s[1]).sum()) - true))
    spread = {k: np.std([e for q, e in errors if q == k]) for k in (0.6, 0.97)}
    assert max(abs(e) for _, e in errors) < 0.17 and spread[0.97] < spread[0.6]  # most precise where it is high


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 4999), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1051)} | {5000: 4999, 4999: 4999}


def test_empty_table(spark, rows):
    assert od.near_duplicates(frame(spark, rows[:2]).limit(0)).count() == 0
