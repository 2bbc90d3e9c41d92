"""A Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "sessionlake", master: str | None = None, **settings: str) -> SparkSession:
    """``settings`` have underscores for dots, as ``spark_driver_memory="4g"``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine it may be unset; then a temporary folder is made."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sessionlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    import uuid

    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
