"""A session with settings for this library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "rostrum", **settings: str) -> SparkSession:
    """Get or create a session; `settings` override DEFAULTS (underscores stand for dots)."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the folder in spark.checkpoint.dir and read back: cuts lineage and survives lost executors.

    Only a local session may leave that folder unset; it then gets a temporary one.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rostrum-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
