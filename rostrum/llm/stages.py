"""Stages of the document pipeline. Each takes (spark, docs, sf_dir) and calls one operator.

All but the last return the columns of documents. Their decisions depend on the text alone where
they can, so null and repeated doc_ids need no special care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text is rejected if no language comes this near: clean texts score above 0.37, noise near 0.
LEAST_LANGUAGE_SCORE = 0.2
MIX_SHARE = 0.9
SHARDS = 8


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter, or far from every profile, go."""
    from .langid import UNKNOWN, learn, predict

    found = predict(docs, learn(docs), language="__language", score="__language_score")
    return found.filter((F.col("__language") != UNKNOWN) & (F.col("__language_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Five-word shingles, similarity 0.8. A null doc_id comes last. Of rows with the same doc_id the
    one whose text has the smallest digest stays, and any one of rows with the same text too.
    """
    from .common import ranked, saved
    from .neardup import near_duplicates

    # without nulls and repeats the doc_ids are the order; else rows are numbered in it first
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    places = ranked(rows.select("__row", "doc_id", F.sha2("text", 256).alias("digest")), [F.asc_nulls_last("doc_id"), F.asc("digest"), F.asc("__row")], "place", "row-places").select("__row", "place")
    places = saved(places, "row-order")
    numbered = rows.select("__row", "text").join(places, "__row").select(F.col("place").alias("doc_id"), "text")
    gone = near_duplicates(numbered).filter("not kept").join(places, F.col("doc_id") == F.col("place")).select(F.col("__row").alias("__gone"))
    return rows.join(gone, rows["__row"] == F.col("__gone"), "left_anti").drop("__row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    from .decontaminate import matches

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    same = F.sha2(F.coalesce("text", F.lit("")), 256)
    hit = matches(docs.select(same.alias("same"), "text"), benchmark, key="same").filter(F.size("spans") > 0)
    return docs.join(hit.select(F.col("key").alias("__hit")).distinct(), same == F.col("__hit"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the target weights: one epoch, MIX_SHARE of all tokens."""
    from .mixing import chosen_documents

    return chosen_documents(docs, MIX_SHARE)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; equal texts together, shards of near equal bytes."""
    from .sharding import shard_documents

    return shard_documents(docs, SHARDS)


STAGES = [
    ("language", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
