import random

import numpy as np
import pytest

from octroi.llm import ngram_join as nj


def shingle_set(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for c in b"\t\n\x0b\x0c\r":
        low = low.replace(bytes([c]), b" ")
    w = [x for x in low.split(b" ") if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(4))
    out = []
    for _ in range(12):  # families of changed copies, many of them near the least similarity
        base = [word() for _ in range(r.randrange(20, 200))]
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    template = [word() for _ in range(60)]  # one long passage that many unlike texts share
    out += [" ".join(template + [word() for _ in range(r.randrange(5, 30))]) for _ in range(40)]
    out += out[:5] + [out[7].upper(), out[8].replace(" ", "\t\n"), "one two", "One\x0btwo", "two one", "x", "x", "", None, " \n", "a b c d", "a b c d e", "long " * 200_000]
    r.shuffle(out)
    rows = [(1000 - i, t) for i, t in enumerate(out)]
    return rows + [rows[3], (rows[5][0], rows[60][1]), (None, rows[4][1]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "s", "t") for d, t in rows], "doc_id long, text string, n int, token string, component string").repartition(5)


def joined(spark, rows, **more):
    return sorted((tuple(r) for r in nj.ngram_join(frame(spark, rows), **more).collect()), key=repr)


def test_rows_equal_brute_force(spark, rows):
    assert joined(spark, rows) == brute(rows)


def test_small_blocks_and_steps_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(nj, "STEP", 3000)
    monkeypatch.setattr(nj, "BUCKET", 5000)
    monkeypatch.setattr(nj, "CARRIED", 2)
    monkeypatch.setattr(nj, "ROUNDS", (5,))
    assert joined(spark, rows, tile=3) == brute(rows)


def test_entries_survive_packing():
    r = np.random.default_rng(1)
    token, ref, count = r.integers(0, 1 << 40, 50, dtype=np.uint64), r.integers(0, 1 << 31, 50), r.integers(1, 1 << 32, 50)
    assert all((a == b).all() for a, b in zip(nj.entries(nj.planes(token, ref, count)), (token, ref, count), strict=True))


def test_parities_never_differ_in_more_bits_than_sets_in_tokens():
    r = np.random.default_rng(4)
    for n in (5, 300, 5000):
        pool = r.integers(0, 1 << 63, n, dtype=np.uint64)
        x, y = pool[: n * 9 // 10], pool[n // 10 :]
        bits = np.bitwise_count(np.frombuffer(nj.parities(x), np.uint8) ^ np.frombuffer(nj.parities(y), np.uint8)).sum()
        assert bits <= len(np.setxor1d(x, y))


def test_similar_sets_share_prefix_tokens_in_every_order():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 60))
        pool = r.integers(0, 1 << 40, n + 12, dtype=np.uint64)
        count = {int(t): int(r.integers(1, 9)) for t in pool}
        x, y = pool[:n], pool[int(r.integers(0, 6)) : n + int(r.integers(0, 3))]
        both = len(np.intersect1d(x, y))
        if 100 * both < nj.LEAST * (len(x) + len(y) - both):
            continue
        for shift, seed in nj.ORDERS:
            heads = []
            for s in (x, y):
                order, _ = nj.ranked_within(np.zeros(len(s), np.int64), s, np.array([count[int(t)] for t in s]), shift, seed)
                heads.append(set(s[order[: int(nj.prefix_size(np.array(len(s))))]].tolist()))
            assert heads[0] & heads[1]


def test_empty_table(spark, rows):
    assert nj.ngram_join(frame(spark, rows[:2]).limit(0)).count() == 0
