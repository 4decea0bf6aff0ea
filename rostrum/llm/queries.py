"""Registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_pruned_graph_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op3_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op5_odd_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import convert_pages

    return convert_pages(spark, table(spark, sf_dir, "pages"))


def op7_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


def op9_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_rank_order_language": op1_rank_order_language,
    "op2_pruned_graph_embeddings": op2_pruned_graph_embeddings,
    "op3_lpt_sharding": op3_lpt_sharding,
    "op4_hierarchical_mixing": op4_hierarchical_mixing,
    "op5_odd_sketch_near_duplicates": op5_odd_sketch_near_duplicates,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_rans_token_ids": op7_rans_token_ids,
    "op8_markov_secrets": op8_markov_secrets,
    "op9_elias_fano_scores": op9_elias_fano_scores,
    "op10_positional_decontamination": op10_positional_decontamination,
}
