"""Seeded sampling and cluster resampling by hashes: the same on any number of partitions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw_key(seed: int, *columns: str) -> Column:
    """md5 of the seed and key: an order that is random in effect, fixed and nested (a larger sample holds a smaller)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each stratum. Spark keeps n rows of each task before it shuffles."""
    order = Window.partitionBy(*strata).orderBy(draw_key(seed, key), key)
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def even_quotas(df: DataFrame, strata: list[str], total: int) -> DataFrame:
    """(strata, size, quota): `total` shared evenly; what small strata cannot fill goes to larger ones; leftovers to the first strata.

    By rising size, a stratum is full if its size is at most the even share of what is left.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    order = Window.orderBy("size", *strata)  # strata are few
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(total) - F.coalesce(F.sum("size").over(before), F.lit(0))
    marked = sizes.withColumn("full", F.col("size") * F.count(F.lit(1)).over(onward) <= left)
    everyone = Window.partitionBy()
    rest = F.lit(total) - F.sum(F.when(F.col("full"), F.col("size")).otherwise(0)).over(everyone)
    open_count = F.sum(F.when(F.col("full"), 0).otherwise(1)).over(everyone)
    place = F.row_number().over(Window.partitionBy("full").orderBy(*strata))
    share = F.floor(F.try_divide(rest, open_count)) + F.when(place <= rest % F.greatest(open_count, F.lit(1)), 1).otherwise(0)
    return marked.select(*strata, "size", F.when(F.col("full"), F.col("size")).otherwise(share).cast("long").alias("quota"))


def quota_sample(df: DataFrame, strata: list[str], key: str, total: int, seed: int) -> DataFrame:
    quotas = even_quotas(df, strata, total)
    order = Window.partitionBy(*strata).orderBy(draw_key(seed, key), key)
    return df.join(F.broadcast(quotas.select(*strata, "quota")), strata).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= F.col("quota")).drop("__n", "quota")


def cluster_weights(clusters: DataFrame, strata: list[str], cluster: str, draws: int, seed: int) -> DataFrame:
    """(draw, strata, cluster, weight): in each draw every stratum picks as many clusters as it has, with replacement.

    Slot s of a draw picks cluster number hash(seed, draw, stratum, slot) mod size, so the table
    has draws x clusters rows before it is summed, and needs no random state.
    """
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(cluster)) - 1
    numbered = clusters.select(*strata, cluster).distinct().withColumn("__i", place)
    sizes = numbered.groupBy(*strata).agg(F.count(F.lit(1)).alias("__m"))
    slots = numbered.join(sizes, strata).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(s).cast("string") for s in strata], F.col("__i").cast("string"))
    picked = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("__m")
    counts = slots.select("draw", *strata, picked.cast("int").alias("__i")).groupBy("draw", *strata, "__i").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(numbered, [*strata, "__i"]).select("draw", *strata, cluster, "weight")


def bootstrap_mean(df: DataFrame, value: str, by: list[str], strata: list[str], cluster: str, draws: int, seed: int) -> DataFrame:
    """Means by group with 95 % percentile intervals over cluster draws, from sums by cluster."""
    sums = df.filter(F.col(value).isNotNull()).groupBy(*by, *[s for s in strata if s not in by], cluster).agg(F.count(F.lit(1)).alias("__cm"), F.sum(value).alias("__cs"))
    weights = cluster_weights(sums, strata, cluster, draws, seed)
    each = sums.join(weights, [*strata, cluster]).groupBy("draw", *by).agg((F.sum(F.col("weight") * F.col("__cs")) / F.sum(F.col("weight") * F.col("__cm"))).alias("value"))
    ends = each.groupBy(*by).agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("__e"))
    point = sums.groupBy(*by).agg((F.sum("__cs") / F.sum("__cm")).alias("mean"), F.sum("__cm").alias("n"))
    return point.join(ends, by).select(*by, "n", "mean", F.col("__e")[0].alias("low"), F.col("__e")[1].alias("high"))


def split_half(df: DataFrame, value: str, unit: str, key: str, splits: int, seed: int) -> DataFrame:
    """Spearman-Brown reliability: units' halves (by hash order) correlated, averaged over splits."""
    from .agreement import pearson

    many = df.filter(F.col(value).isNotNull()).select(unit, key, value).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("split").cast("string"), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy("split", unit).orderBy(text, key))
    half = many.withColumn("half", place % 2).groupBy("split", unit).agg(F.avg(F.when(F.col("half") == 0, F.col(value))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col(value))).alias("b"))
    each = half.filter("a is not null and b is not null").groupBy("split").agg(pearson(F.col("a"), F.col("b")).alias("r"))
    mean = each.agg(F.avg("r").alias("r"), F.count("r").alias("n_splits"))
    return mean.select("n_splits", "r", F.try_divide(2 * F.col("r"), 1 + F.col("r")).alias("reliability"))
