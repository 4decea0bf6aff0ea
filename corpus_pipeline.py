"""Document pipeline: stages that each call one training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm.stages import STAGES

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each reading what the one before wrote."""
    from rostrum.llm.common import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
