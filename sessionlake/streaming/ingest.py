"""New sessions of a lake as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SESSION_PATH
from ..sources.lake import table_dir


def stream_lake(spark: SparkSession, lake: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of sessions as they are ingested."""
    path = table_dir(lake, table)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def session_lengths(rows: DataFrame) -> DataFrame:
    """Rows of each session so far."""
    return rows.groupBy(SESSION_PATH).agg(F.count("*").alias("n_rows"))
