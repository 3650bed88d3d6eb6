import numpy as np
import pytest

from octroi.llm import kmeans_tree as kt

INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0.5, 1) for i, e in rows], "vec_id long, embedding array<float>, score double, leaf int").repartition(5)


def brute(rows, k=20, every=20):
    kept = {}
    for i, e in rows:
        if i is not None and e and None not in e and all(np.isfinite(e)) and any(e):
            kept[i] = min(kept.get(i, e), e)
    lengths = [len(e) for e in kept.values()]
    width = max(sorted(set(lengths)), key=lambda d: (lengths.count(d), -d), default=0)
    kept = {i: np.float32(e).astype(float) for i, e in kept.items() if len(e) == width}
    out = {}
    for q in kept:
        if q % every == 0:
            out[q] = sorted(((-float(v @ kept[q]), i) for i, v in kept.items() if i != q))[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    centres = r.standard_normal((30, 12)) * 2
    rows = [(i, (centres[r.integers(30)] + r.standard_normal(12)).astype(np.float32).tolist()) for i in range(3000)]
    same = rows[7][1]
    rows += [(i, same) for i in range(4000, 4500)]  # one vector in many rows
    rows += [(5000, None), (5020, []), (5040, [0.0] * 12), (5060, [None] + same[1:]), (5080, [NAN] + same[1:]), (5100, [INF] + same[1:]), (5120, same[:3]), (None, same), (40, rows[40][1]), (60, same)]
    return rows


def test_recall_and_exact_scores(spark, rows):
    got = {}
    for r in kt.search(frame(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        keys = [(-round(s, 9), i) for _, i, s in found]
        assert keys == sorted(keys)
        true = {i: -s for s, i in want[q]}
        hits += len(true.keys() & {f[1] for f in found})
        assert all(s == pytest.approx(true[i], rel=1e-12) for _, i, s in found if i in true)
    assert hits / (20 * len(got)) >= 0.9


def test_few_candidates_are_all_returned(spark, rows):
    few = [(i, rows[i][1]) for i in (0, 1, 2, 20)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in kt.search(frame(spark, few)).collect())
    assert got == sorted((q, n + 1, i) for q, found in brute(few).items() for n, (_, i) in enumerate(found))
    assert kt.search(frame(spark, few).limit(0)).count() == 0


def test_best_first_opens_every_leaf_once_and_the_nearest_first():
    x = np.random.default_rng(0).standard_normal((2000, 6))
    tree = kt.Tree(x, 50)
    leaf = tree.descend(x)
    assert set(leaf.tolist()) <= set(range(tree.leaves)) and tree.leaves > 20
    for q in x[:20]:
        assert sorted(tree.best_first(q)) == list(range(tree.leaves))
    assert np.mean([next(tree.best_first(q)) == n for q, n in zip(x, leaf, strict=True)]) > 0.99


def test_crowded_leaves_are_tiled(spark, rows, monkeypatch):
    monkeypatch.setattr(kt, "TILE", 50)
    some = rows[:1200]
    got = {(r.query_id, r.vec_id) for r in kt.search(frame(spark, some), recall=1.0).collect()}
    assert len(got & {(q, i) for q, f in brute(some).items() for _, i in f}) >= 0.9 * 20 * 60
