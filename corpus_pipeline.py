"""The corpus pipeline: quality, repeated runs, near duplicates, mixing, sentence pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import mixing, near_duplicates, pieces, quality, repeated_runs, work
from footfall.llm.catalog import tokenizer_file

#: SQL cannot express the estimates, signatures and searches of the stages; the tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut from the texts; every document stays."""
    cut = repeated_runs.remove_repeated_runs(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their target shares of a share of all tokens.

    No document comes twice; cells that are sought more than they have come whole.
    Texts without a word are all drawn, so of equal ones (copies that ``line_dedup`` emptied) one is let through.
    """
    return mixing.sampled(near_duplicates.one_wordless_of_each(docs), share=mixing.SHARE, once=True)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the best segmentations, the text that they decode to, and whether each of them gives the text back."""
    return pieces.encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentence_pieces", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.written(stage(spark, docs, sf_dir), name)
    return docs
