"""Attempt logs as streams: the effective attempt of each key is kept in a table that batches update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import effective_rows


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window; rows later than `late` are dropped from state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))


def follow(stream: DataFrame, table: str, checkpoint: str, key: list[str], ok: str, order: str):
    """Start a query that folds new attempts into versions of a table: <table>/v=<batch>. Replayed batches overwrite their own version."""
    spark = stream.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        old = None
        if number:
            old = spark.read.parquet(f"{table}/v={number - 1}")
        rows = batch if old is None else old.unionByName(batch)
        effective_rows(rows, key, ok, order).write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
