"""Readers with declared schemas and early checks; every reader is lazy and column-pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("speech_id",)]
    + [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in ("member_id", "party", "chamber")]
    + [T.StructField("congress_number", T.ShortType())]
    + [T.StructField(c, T.StringType()) for c in ("text", "source", "last_name", "state")]
    + [T.StructField("word_count", T.IntegerType()), T.StructField("party_original", T.StringType()), T.StructField("icpsr", T.IntegerType())]
)
AFFILIATION = "array<struct<start:date,end:date,party:string,caucus:string>>"
TERMS = f"array<struct<type:string,state:string,party:string,start:date,end:date,caucus:string,party_affiliations:{AFFILIATION}>>"
PERSONS = f"id struct<bioguide:string,icpsr:int>, name struct<first:string,last:string,nickname:string,official_full:string>, terms {TERMS}"


class MissingColumns(ValueError):
    pass


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Named columns of parquet files; a missing one stops before any row is read."""
    df = spark.read.parquet(path)
    absent = [c for c in columns or [] if c not in df.columns]
    if absent:
        raise MissingColumns(f"{path}: {absent}")
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """JSON lines under a schema; malformed lines stop the read, as do nulls in required fields, when rows are used."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required or []:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{path}: {c} is missing"))).otherwise(F.col(c)))
    return df


def csv(spark: SparkSession, path: str, schema: str, separator: str = ",", encoding: str = "UTF-8", comment: str | None = None, quote: str | None = '"') -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("sep", separator).option("encoding", encoding).option("enforceSchema", True)
    reader = reader.option("comment", comment) if comment else reader
    return reader.option("quote", quote if quote else "\u0000").csv(path)


def persons_to_terms(persons: DataFrame) -> DataFrame:
    """One row for each term served: folded last name, the set of first names, and dated affiliations."""
    from ..functions.text import fold

    names = F.array_distinct(F.filter(F.array("name.first", "name.nickname"), lambda n: n.isNotNull()))
    rows = persons.select(F.col("id.bioguide").alias("person"), F.col("id.icpsr").alias("icpsr"), fold(F.col("name.last")).alias("last"), names.alias("firsts"), F.explode("terms").alias("t"))
    return rows.select("person", "icpsr", "last", F.transform("firsts", F.upper).alias("firsts"), F.when(F.col("t.type") == "sen", "S").otherwise("H").alias("chamber"), "t.state", "t.start", "t.end", "t.party", "t.caucus", F.col("t.party_affiliations").alias("affiliations"))


def ids_from_text(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; # starts a comment, blank lines are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("id"))
    return rows.filter((F.col("id") != "") & ~F.col("id").startswith("#"))


def rows_of_ids(corpus: DataFrame, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Named columns of the wanted ids in the order of `ids` (key, pos)."""
    return ids.join(corpus.select(*dict.fromkeys([key, *columns])), key, "left").orderBy("pos").select(*columns)


def union_with_nulls(first: DataFrame, second: DataFrame, schema: T.StructType) -> DataFrame:
    """Both sides under one schema; columns that one side lacks are null, other columns are dropped."""
    def under(df):
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    return under(first).unionByName(under(second))
