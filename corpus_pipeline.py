"""A corpus from documents to token ids, in stages that each call one operator on all that the stage before kept.

Every stage but the last returns the columns of documents. Its output is written as Parquet to the
shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm import bpe, decontamination, neardup, passages, quality
from tallycast.llm.common import staged, table
from tallycast.llm.training import remainder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document is rejected below this quality score.
LEAST_QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the rule ensemble, learned from the labels, takes for low quality."""
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"), remainder(4) == 2)
    return quality.at_least(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return neardup.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated paragraphs and passages out of all but the first document that has them."""
    return passages.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, checked by decoding them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_and_decode(docs, path)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", benchmark_free),
    ("token_ids", token_ids),
]

#: Learned weights and BPE merges have no SQL form; tests hold every stage against a brute-force version on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = staged(stage(spark, out, sf_dir), f"stage-{name}")
    return out
