import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octroi.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=300))))
def test_any_width_round_trips(case):
    bits, ids = case
    a = np.array(ids, np.uint32)
    f = ts.TokenFile(ts.file_bytes([5, None], np.array([0, len(a)]), a, bits, block=16))
    assert f.doc_ids == [5, None] and f.ids(0, len(a)).tolist() == ids
    if len(a) > 20:
        assert f.ids(3, 19).tolist() == ids[3:19]


def test_width_is_the_least():
    assert [ts.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_give_the_librarys_ids(texts):
    texts = texts + ["\x01\x02 a\x01b \x01", "a <|endoftext|>b's ΟΔΟΣ́ é ́x y\x1cz q", "It'll  do\n\tthis"]
    ids, n = ts.encoder(PATH)([x.encode("utf-8", "ignore") for x in texts])
    want = [w[:-1] for w in expected([x.encode("utf-8", "ignore").decode() for x in texts])]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["one two", "", None, "x " * 300_000, "one two", "Ünï çode ☃ 😀", "last"]
    return texts, spark.createDataFrame([(None if i == 1 else i - i % 2 * (i > 3), t, "n", 3) for i, t in enumerate(texts)], "doc_id long, text string, start string, n_tokens int")


def test_rows_equal_brute_force(spark, odd, monkeypatch):
    texts, docs = odd
    got = [tuple(r) for r in ts.token_store(docs, PATH).collect()]
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (d, _), ids in zip(rows, expected([t for _, t in rows]), strict=True):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark, odd):
    assert ts.token_store(odd[1].limit(0), PATH).count() == 0
