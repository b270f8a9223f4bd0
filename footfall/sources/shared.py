"""Where tables that a report stores for others lie: a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the warehouse; in local mode a folder of this machine, set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="run-")
            spark.conf.set("spark.checkpoint.dir", folder)
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was ever written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
