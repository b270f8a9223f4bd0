"""Tables that an operator writes and reads again, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.sources.shared import new_path, shared_folder

__all__ = ["NO_ID", "id_or_none", "keyed_texts", "new_path", "shared_folder", "written"]

#: Stands for a document without an id inside the operators; results show NULL again.
NO_ID = -(2**63)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet and read again: cuts its lineage and bounds what a lost executor costs."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def id_or_none(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a missing id is ``NO_ID``, a missing text empty."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
