"""Labelled rows for classifiers: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """text, label of about `bound` labelled rows at most, the same ones each time.

    The sample is drawn from the labels by a hash of doc_id, so what is broadcast to the documents is
    bounded too. A doc_id with several labels counts with the largest; null labels don't count.
    """
    marked = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")).where("label is not null")
    n = marked.count()
    share = min(1.0, bound / max(1, n))
    few = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
