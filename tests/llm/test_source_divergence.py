import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from octroi.llm import source_divergence as sd


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(rows, least=3, top=200):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(t)
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= least]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        shares = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: B023, E731
        q, p = shares(whole), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeÉéß漢🙂") for _ in range(r.choice([1, 2, 5, 7, 8, 9, 15, 16, 17, 33, 70]))) for _ in range(150)] + ["The", "the", "LONG" * 300]
    rows = []
    for _ in range(300):
        pick = r.sample(words, 12)
        rows.append((r.choice([" ", "-", "7", "\n", "\x7f", "_"]).join(r.choice(pick) for _ in range(r.randrange(0, 40))), r.choice(["en", "en", "fr", None, ""]), r.choice(["a", "a", "b", "é", None, ""])))
    return rows + [(None, "en", "only null"), ("", "de", "x"), ("12", "de", "y"), ("alone", "it", "z"), (None, None, None), ("word " * 100_000, "en", "a")] + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(t, x, s, 1, "k") for t, x, s in rows], "text string, lang string, source string, count int, term string").repartition(4)


def test_rows_equal_brute_force(spark, rows):
    got = sorted(tuple(r) for r in sd.divergence(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_small_steps_and_top_ranks(spark, rows, monkeypatch):
    monkeypatch.setattr(sd, "STEP", 500)
    got = sorted(tuple(r) for r in sd.divergence(frame(spark, rows), least_docs=1, top=2).collect())
    assert got == brute(rows, 1, 2)


def test_radix_order_is_stable():
    r = np.random.default_rng(1)
    keys = [r.integers(0, 3, 500, dtype=np.uint64), r.integers(0, 2**63, 500, dtype=np.uint64) >> np.uint64(r.integers(0, 60))]
    assert (sd.radix_order(keys) == np.lexsort(keys[::-1])).all()


def test_packed_words_keep_the_order_of_bytes():
    terms_ = [b"a", b"ab", b"abcdefgh", "é".encode(), b"abcdefghi", b"b"]
    data = np.frombuffer(b"".join(terms_), np.uint8)
    size = np.array([len(t) for t in terms_])
    start = np.cumsum(size) - size
    order = sd.radix_order(sd.pack_words(data, start, size, 2))
    assert [terms_[i] for i in order] == sorted(terms_)


def test_empty_table(spark, rows):
    assert sd.divergence(frame(spark, rows[:2]).limit(0)).count() == 0
