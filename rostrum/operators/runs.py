"""Scoring runs: attempt logs, what is still owed, ensembles and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import effective_rows


def pending(ids: DataFrame, attempts: DataFrame, models: list[str], key: str = "speech_id", model: str = "model", error: str = "error") -> DataFrame:
    """(key, owed): the models that have no successful attempt for an id, sorted."""
    wanted = ids.select(key).distinct().withColumn(model, F.explode(F.array(*map(F.lit, models))))
    done = attempts.filter(F.col(error).isNull()).select(key, model).distinct()
    owed = wanted.join(done, [key, model], "left_anti")
    return owed.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(model)), ",").alias("owed"))


def ensemble(attempts: DataFrame, scores: list[str], key: str = "speech_id", model: str = "model", error: str = "error", order: str = "attempt") -> DataFrame:
    """Mean and sample deviation over each id's models, from effective successful attempts."""
    rows = effective_rows(attempts.withColumn("__ok", F.col(error).isNull()), [key, model], "__ok", order).filter("__ok")
    sums = [f(s).alias(f"{s}_{n}") for s in scores for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return rows.groupBy(key).agg(*sums, F.count(F.lit(1)).alias("n_models"))


def run_summary(attempts: DataFrame, key: str = "speech_id", model: str = "model", error: str = "error") -> DataFrame:
    """Attempts, failures and distinct ids by model; an error's class is the text before its colon."""
    return attempts.groupBy(model).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col(error).isNotNull()).alias("failures"), F.count_distinct(key).alias("ids"),
        F.count_distinct(F.split(error, ":")[0]).alias("error_classes"),
    )
