"""Registered queries of this subpackage: thin bindings of the operators to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm import bpe, decontamination, lm_scoring, neardup, passages, quality, sharding, simhash, spelling, spotsigs, tokenfiles, toxicity, trie
from tallycast.llm.common import fresh_path, table
from tallycast.llm.training import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op9_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    read = tokenfiles.read_all(manifest, folder)
    return read.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op10_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(3) == 1
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op8_quality_rules")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(4) == 2
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"), held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op5_spotsigs")
def spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spotsigs.probes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op7_prob_minhash")
def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_minimax_shards")
def minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_by_bytes(table(spark, sf_dir, "documents"))


@query("op2_spaced_seeds", decontamination.ORACLE)
def benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op1_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removals(table(spark, sf_dir, "documents")).drop("node")


@query("op6_cross_entropy_difference")
def cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm_scoring.fit(docs, lm_scoring.labelled(docs, table(spark, sf_dir, "labels")))
    return lm_scoring.score(docs, model)


@query("op11_simhash_pivots")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants", spelling.ORACLE)
def spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", trie.ORACLE)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
