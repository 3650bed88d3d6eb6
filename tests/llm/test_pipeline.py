import hashlib

import pytest

import __spark_entry__
import corpus_pipeline as cp
import test_odd_sketch
import test_phrase_index
import test_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of each stage over a small table."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in cp.STAGES:
        made = cp.written(stage(spark, docs, FOLDER), "stage")
        out.append((docs.collect(), made.collect()))
        docs = made
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near duplicates", "repeated strings", "decontamination", "sampled pieces"]
    assert all(list(r.asDict()) == cp.COLUMNS for _, made in stages[:-1] for r in made[:1])


def test_near_duplicates_against_all_pairs(stages):
    before, after = stages[1]
    want = {d for d, _, _, kept in test_odd_sketch.brute([(r.doc_id, r.text) for r in before]) if kept}
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_repeats_against_all_strings(stages):
    before, after = stages[2]
    want = {r[0]: (r[1] - r[2], r[4]) for r in test_repeats.brute([(r.doc_id, r.text) for r in before])}
    assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
    for r in after:  # the kept bytes, but for characters cut in two
        assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][1] or len(r.text.encode()) < want[r.doc_id][0]


def test_decontamination_against_brute_force(spark, stages):
    before, after = stages[3]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = [d for d, *_, bad in test_phrase_index.brute([(r.doc_id, r.text) for r in before], items) if not bad]
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_pieces_decode_to_the_texts(stages):
    before, after = stages[4]
    assert {(r.doc_id, r.decoded_sha256) for r in after} == {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before}


def test_quality_stage_keeps_good_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    kept = {r.doc_id for r in cp.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [d for d in label if label[d] == 1]
    bad = [d for d in label if label[d] == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.15 * len(bad)


def test_odd_rows_pass_through(spark, tmp_path):
    rows = [(1, "a b c", "en", None, None), (1, "a b c", "en", None, None), (None, "a b c", None, None, 1), (None, None, None, None, None), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == [1, 2, None, None]
