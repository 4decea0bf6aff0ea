"""Agreement of raters and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over the full grid of labels that either rater uses."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.select(F.col("a").alias("label")).union(pairs.select("b")).distinct()
    grid = labels.select(F.col("label").alias("a")).crossJoin(labels.select(F.col("label").alias("b")))  # labels are few
    return grid.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, accuracy, kappa (null where chance agreement is 1) and macro-averaged F1 in one row."""
    grid = confusion(df, a, b)
    rows = grid.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("row"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("hit"))
    columns = grid.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("col"))
    both = rows.join(columns, "label")
    f1 = F.try_divide(2 * F.col("hit"), F.col("row") + F.col("col"))
    total = both.agg(F.sum("row").alias("n"), F.sum("hit").alias("hits"), F.sum(F.col("row") * F.col("col")).alias("chance"), F.avg(F.coalesce(f1, F.lit(0.0))).alias("macro_f1"))
    po, pe = F.try_divide("hits", "n"), F.try_divide(F.col("chance"), F.col("n") * F.col("n"))
    return total.select("n", po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"), "macro_f1")


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank with ties averaged."""
    tied = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate; null below three pairs or without variation (no division error)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of each group with Fisher intervals of the first."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumn("__rx", average_rank(F.col(x), by)).withColumn("__ry", average_rank(F.col(y), by))
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("pearson"), pearson(F.col("__rx"), F.col("__ry")).alias("spearman"))
    half = F.when(F.col("n") > 3, F.lit(1.959964) / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1))))
    return out.withColumn("ci_low", F.tanh(F.atanh("pearson") - half)).withColumn("ci_high", F.tanh(F.atanh("pearson") + half))


def intraclass(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """One-way ICC(1) for unequal group sizes."""
    g = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.count(F.lit(1)).alias("__m"), F.avg(value).alias("__a"), F.sum(F.col(value) * F.col(value)).alias("__q"))
    m, a = F.col("__m"), F.col("__a")
    t = g.groupBy(*by).agg(F.count(F.lit(1)).alias("__k"), F.sum(m).alias("__n"), F.sum(m * m).alias("__mm"), F.sum(m * a).alias("__s"), F.sum(m * a * a).alias("__b"), F.sum("__q").alias("__sq"))
    k, n, between = F.col("__k"), F.col("__n"), F.col("__b")
    msb = F.try_divide(between - F.col("__s") * F.col("__s") / n, k - 1)
    msw = F.try_divide(F.col("__sq") - between, n - k)
    m0 = F.try_divide(n - F.col("__mm") / n, k - 1)
    return t.select(*by, n.alias("n"), k.alias("n_groups"), F.try_divide(msb - msw, msb + (m0 - 1) * msw).alias("icc"))


def holm(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Holm-adjusted p values within each family."""
    order = Window.partitionBy(*by).orderBy(p)
    step = (F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("__step", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__step")
