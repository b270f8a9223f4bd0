"""Registered queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    classifier,
    digest_sql,
    manifest,
    mixing,
    near_duplicates,
    personal_data,
    pieces,
    quality,
    repeated_runs,
    resampling,
    sharding,
    syncmers,
    token_files,
    toxicity,
    work,
)

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode_and_decode(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", "ids", "best", "decoded", "round_trip")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work.new_path(spark, "token-files")
    token_files.write_ids(documents(spark, sf_dir), path, tokenizer_file("word_bpe_49k.json"))
    return token_files.digests(token_files.read_ids(spark, path))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_runs.remove_repeated_runs(documents(spark, sf_dir), removed="n_removed_words")
    return rows.select("doc_id", "text", "n_removed_words")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(documents(spark, sf_dir))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(documents(spark, sf_dir))
    return rows.select("doc_id", *quality.STATS, "base_failed", "kept", "posterior")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(documents(spark, sf_dir), all_rows=True, share=mixing.SHARE)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document, and its shard if the first one were lost."""
    docs = documents(spark, sf_dir).select("doc_id")
    placed = sharding.place(docs)
    rows = sharding.place(placed, shards=sharding.SHARDS[1:], name="shard_without_first")
    return rows.select("doc_id", sharding.slot_of(F.col("doc_id")).alias("slot"), "shard", "shard_without_first")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir), manifest.tampered()).proofs()


def queries() -> dict[str, Query]:
    found = (
        op1_sentence_pieces,
        op2_near_duplicates,
        op3_token_files,
        op4_toxicity,
        op5_repeated_runs,
        op6_personal_data,
        op7_syncmers,
        op8_quality_rules,
        op9_source_mixing,
        op10_sharding,
        op11_importance_resampling,
        op12_quality_classifier,
        op13_merkle_manifest,
    )
    return {query.__name__: query for query in found}


def _sharding_sql() -> str:
    def names(shards) -> str:
        return ", ".join(f"'{shards[i]}'" for i in sharding.lookup_table(shards))

    slot = f"('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {sharding.SLOTS}"
    return (
        f"WITH t AS (SELECT [{names(sharding.SHARDS)}] AS a, [{names(sharding.SHARDS[1:])}] AS b), "
        f"d AS (SELECT doc_id, {slot} AS slot FROM documents) "
        "SELECT doc_id, slot, a[slot + 1] AS shard, b[slot + 1] AS shard_without_first FROM d, t"
    )


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are held against brute force in the tests."""
    return {
        "op10_sharding": _sharding_sql(),
        "op11_importance_resampling": digest_sql.resampling_sql(),
        "op13_merkle_manifest": digest_sql.manifest_sql(),
    }
