"""The session lake: tables of containers as Parquet, partitioned by session."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SESSION_PATH, normalise

SESSION = "session"


def table_dir(lake: str, table: str) -> str:
    return f"{lake.rstrip('/')}/{normalise(table).replace('/', '.')}"


def ingest(spark: SparkSession, source: Any, table: str, lake: str, mode: str = "append", **scan_options: Any) -> str:
    """Writes a table's rows of all sessions below the lake's folder; a reader
    then skips sessions and columns by file names and statistics.  A session's
    rows stay in the tasks that read them, so nothing is shuffled."""
    from ..operators.scan import scan

    df = scan(spark, source, table, **scan_options)
    name = F.regexp_replace(F.element_at(F.split(SESSION_PATH, "/"), -1), r"[^\w.-]", "_")
    path = table_dir(lake, table)
    # sessions in different folders may have files of one name
    df.withColumn(SESSION, F.concat(name, F.lit("-"), F.substring(F.md5(F.col(SESSION_PATH)), 1, 8))).write.mode(mode).partitionBy(SESSION).parquet(path)
    return path


def scan_lake(spark: SparkSession, lake: str, table: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_dir(lake, table))
    return df if columns is None else df.select(*columns)
