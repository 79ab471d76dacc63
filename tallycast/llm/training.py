"""Labelled rows for the classifiers: a bounded, reproducible sample of the rows that may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier learns from at most; the rows with the smallest hashes are taken.
TRAIN_ROWS = 6000


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and label of at most `most` rows of each class, none of them held out.

    The sample is taken from the labels alone, so its ids (two times `most` at most) can be
    broadcast to the texts, which are scanned once and never shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    sampled = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = sampled[0].unionAll(sampled[1])
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
