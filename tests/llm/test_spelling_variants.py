import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from octroi.llm import spelling_variants as sv


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def brute(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    letters = {c for w in n for c in w}
    form, out = {}, {}
    for w, k in n.items():
        near = {x for x in edits(w, letters) if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
        out[w] = len(near)
    rows = []
    for w, k in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, k, out[w], n[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    stems = ["".join(r.choice("abéö") for _ in range(r.randrange(6, 12))) for _ in range(40)] + ["préfixe" + "".join(r.choice("abcd") for _ in range(4)) for _ in range(60)]
    words = []
    for s in stems:
        words += [s] * r.choice([1, 3, 40, 500])
        for _ in range(r.randrange(0, 8)):
            words += [r.choice(list(edits(s, "abéö")))] * r.choice([1, 2, 3, 20])
    words += ["chainaaaaa"] * 400 + ["chainaaaab"] * 40 + ["chainaaabb"] * 4 + ["l" * 3000] * 3 + ["l" * 3001] * 40 + ["ÀÉÎÕÜÑÝ", "ÀÉÎÕÜÑß"] * 2 + ["WORDLIKE", "wordlike", "Wordlikes", "wordlikes"]
    r.shuffle(words)
    texts = [" ".join(words[i : i + 60]) for i in range(0, len(words), 60)]
    rows = [(i, t.replace(" ", r.choice([" ", "-", "1", "\n", "×", "Ā"]))) for i, t in enumerate(texts)]
    return rows + [(None, texts[0]), (3, None), (4, ""), (5, "— 12"), rows[2]]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", 5) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)


def test_rows_equal_brute_force(spark, rows):
    got = sorted((tuple(r) for r in sv.spelling_variants(frame(spark, rows)).collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_small_tiles_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(sv, "PAIRS", 7)
    got = sorted((tuple(r) for r in sv.spelling_variants(frame(spark, rows), tile=2).collect()), key=repr)
    assert got == brute(rows)


def test_each_single_edit_is_found_in_one_window():
    r = random.Random(1)
    for _ in range(300):
        w = "".join(r.choice("ab") for _ in range(r.randrange(7, 12)))
        others = sorted({x for x in edits(w, "abc")} - {w})
        for other in r.sample(others, 5):
            size = min(len(w), len(other))
            bounds = np.stack(sv.window_bounds(np.array([size])))[:, 0]
            keys = lambda v, k: (v[: bounds[k]], v[len(v) - max(size - bounds[k + 1], 0) :])  # noqa: B023, E731
            found = 0
            for k in range(sv.WINDOWS):
                x, y = sv.near_in_tiles(size, np.array([k, k]), np.array([1, 1]), np.ones(2, bool), np.ones(2, bool), [w, other])
                if len(x):
                    assert keys(w, k) == keys(other, k)
                found += len(x)
            assert found == 1


def test_unlike_words_are_not_near():
    words = ["abcdefg", "abcdegf", "abcdefghi", "bcdefgab", "abxdexg"]
    n = len(words)
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for size in (7, 8, 9):
        for k in range(sv.WINDOWS):
            x, _ = sv.near_in_tiles(size, np.full(n, k), np.ones(n, int), np.ones(n, bool), np.ones(n, bool), [w for w in words if len(w) <= size + 1] + ["q" * size] * sum(len(w) > size + 1 for w in words))
            assert not len(x)


def test_empty_table(spark, rows):
    assert sv.spelling_variants(frame(spark, rows[:2]).limit(0)).count() == 0
