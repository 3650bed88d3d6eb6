"""Five stages from raw documents to sampled token pieces; each works on what the one before has kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`.

Cases: rows with nulls pass through as the operators say; a row without doc_id is never dropped as a copy.
Rows that repeat a doc_id are one document for the near-duplicate stage, of which the first by text stays.
Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octroi.llm.byte_cnn import keep_quality
from octroi.llm.common import table
from octroi.llm.odd_sketch import near_duplicates
from octroi.llm.phrase_index import clean_documents
from octroi.llm.piece_sampler import sampled_pieces
from octroi.llm.repeats import remove_repeats
from octroi.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL for the rows of run(): the trained network and the sampled pieces have none.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network rejects go."""
    return keep_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    once = docs.join(kept, "doc_id").withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("row = 1")
    return once.select(COLUMNS).union(docs.where("doc_id is null").select(COLUMNS))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start in two places are cut out of both; n_chars is counted anew."""
    left = remove_repeats(docs, texts=True, carry=("lang", "source"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside a benchmark window go."""
    return clean_documents(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, checked to decode to its text."""
    return sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated strings", repeat_stage),
    ("decontamination", decontamination_stage),
    ("sampled pieces", piece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
