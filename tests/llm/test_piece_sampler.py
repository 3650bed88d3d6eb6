import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octroi.llm import piece_sampler as ps

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sampler():
    return ps.Sampler(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabcé☃😀￿\x00"), st.characters(exclude_categories=["Cs"])), max_size=40)), max_size=6))
def test_decoding_is_lossless(rows):
    s = ps.sampler(PATH, ps.ALPHA, ps.SEED)
    keys, texts = [k for k, _ in rows], [t for _, t in rows]
    ids, n = s.encode(keys, texts)
    assert s.decode(ids, n) == [t.encode() for t in texts]
    ends = np.cumsum(n)
    for k, t, a, b in zip(keys, texts, ends - n, ends, strict=True):  # a row's pieces don't hang on its neighbours
        alone, _ = s.encode([k], [t])
        assert alone.tolist() == ids[a:b].tolist()


def test_samples_follow_the_lattice(sampler):
    """Frequencies of whole segmentations against their weights, listed one by one."""
    word = " there"
    p = sampler.pieces
    weight = {bytes(p.spelled[p.spelled_at[i] : p.spelled_at[i + 1]]).decode("utf-8", "replace"): (int(i), p.weight[k]) for k, i in enumerate(p.piece) if i >= 0}
    ways = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if all(x in weight for x in parts):
            ways[tuple(weight[x][0] for x in parts)] = math.exp(sum(weight[x][1] for x in parts))
    total = sum(ways.values())
    n = 40_000
    ids, count = sampler.encode(list(range(n)), [word[1:]] * n)
    ends = np.cumsum(count)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends - count, ends, strict=True))
    assert set(seen) <= set(ways) and len(seen) > 5
    for way, w in ways.items():
        share = w / total
        assert abs(seen[way] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_long_words_and_seeds(sampler):
    text = "x" * 30_000 + "ü☃" * 500
    a, n = sampler.encode([7], [text])
    assert sampler.decode(a, n) == [text.encode()]
    assert a.tolist() != ps.Sampler(PATH, seed=2).encode([7], [text])[0].tolist() != sampler.encode([8], [text])[0].tolist()


def test_rows(spark):
    rows = [(1, "Some text, twice  spaced\nand more"), (1, "Some text, twice  spaced\nand more"), (2, None), (3, ""), (None, "▁ null key"), (4, " lead and trail ")]
    docs = spark.createDataFrame([(*r, 9, "i") for r in rows], "doc_id long, text string, n_pieces int, ids string")
    got = ps.sampled_pieces(docs, PATH, ids=True).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.decoded_sha256) for r in got) == sorted((repr(d), len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert all(len(r.ids) == r.n_pieces for r in got) and len({tuple(r.ids) for r in got if r.doc_id == 1}) == 1
    assert ps.sampled_pieces(docs.limit(0), PATH).count() == 0


def test_the_largest_draw_still_finds_a_piece(sampler, monkeypatch):
    monkeypatch.setattr(ps, "mix", lambda h: np.full_like(h, np.iinfo(np.uint64).max))
    ids, n = sampler.encode([1], ["every word is drawn ☃"])
    assert sampler.decode(ids, n) == ["every word is drawn ☃".encode()]
