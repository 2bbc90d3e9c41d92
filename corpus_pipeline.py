"""A pipeline of operators over ``documents``; each stage is written and read again.

A stage takes all rows that its predecessor kept.  All but the last return the
columns of documents: toxic documents go, then those that fail the quality
rules or come from a rejected host, then all but one of each group of near
copies; what stays is packed into batches.  Each row is judged by its own text,
also where rows share a ``doc_id``; a row whose ``doc_id`` is null isn't told
apart by it, so it is never dropped as a near copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import jaccard, packing, quality, toxicity
from sessionlake.llm.common import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out(F.col("id")))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    scored = toxicity.score(docs, model, rest=rest, name="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs, carry=tuple(docs.columns)).filter("kept")
    return judged.select(*[F.col(f"carried{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.distinct_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: The classifier is fitted by an iteration that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
